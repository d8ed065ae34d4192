"""Proposals of a model: requests, the hook that asks it, its answers, and names from a dictionary with them.

A model is any function on a pandas table of requests; a run without one leaves proposals out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from .answers import Answers
from .audit import component_issues, context_findings
from .core import cut, merged, missing, replace_rows
from .dictionary import CONTEXT, apply_status, assign_strata, deterministic_results, naming_issues, segment_names
from .judging import Rule, judged
from .naming import FAILED, accept_resolution, ids, review_rounds


COMPONENT = "struct<fragment:string,full:string,korean:string,origin:string>"


def encode_requests(sources: DataFrame, segments: DataFrame, dictionary: DataFrame, k: int = 4) -> DataFrame:
    """source_id and request: compact JSON of the source's context, its first k segmentations, and all senses of
    their fragments and of the whole name. segments: what segment_names gives."""
    key = ["column_name", "table_name", "table_description"]
    rows = sources.select("source_id", "data_type", *[F.coalesce(c, F.lit("")).alias(c) for c in key])
    few = segments.filter(F.col("rank") <= k)
    parts = F.transform(F.arrays_zip("fragments", "full_names", "korean_words", "origins"), lambda x: F.struct(x["fragments"].alias("source_fragment"), x["full_names"].alias("full_name"), x["korean_words"].alias("korean_word"), x["origins"].alias("origin")))
    unresolved = F.transform(F.filter(F.arrays_zip("fragments", "origins"), lambda x: x["origins"] == "inference"), lambda x: x["fragments"])
    size = F.length(X.compact_identifier(F.col("column_name")))
    candidate = F.struct("rank", parts.alias("components"), unresolved.alias("unresolved_fragments"), F.round(F.col("covered") / size, 6).alias("coverage"), "score")
    found = few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(candidate)), lambda c: c.dropFields("rank")).alias("candidates"))
    asked = few.select(*key, F.explode("fragments").alias("abbreviation")).unionByName(few.select(*key, X.compact_identifier(F.col("column_name")).alias("abbreviation"))).distinct()
    sense = F.struct((-F.col("occurrence_count")).alias("o"), "full_name", "korean_word", "occurrence_count")
    senses = dictionary.groupBy("abbreviation").agg(F.transform(F.array_sort(F.collect_set(sense)), lambda s: s.dropFields("o")).alias("senses"))
    options = asked.join(senses, "abbreviation").groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("abbreviation", "senses")))).alias("mapping_options"))
    rows = rows.join(found, key, "left").join(options, key, "left")
    source = F.struct("source_id", "table_name", "table_description", "column_name", "data_type")
    return rows.select("source_id", F.to_json(F.struct(source.alias("source"), F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)).alias("candidates"), F.coalesce("mapping_options", F.create_map().cast(options.schema["mapping_options"].dataType)).alias("mapping_options"))).alias("request"))


def propose(requests: DataFrame, model: Callable[[pd.DataFrame], Iterable[str]], batch: int = 20, attempts: int = 2, answers: Answers | None = None, round_: int = 0) -> DataFrame:
    """Asks the model for batches of at most `batch` requests (source_id, row_no, request): batch, source_ids, answer and
    failure_code ('' if it answered). model gives one answer for each table of requests that it gets.

    A batch that fails is asked again up to `attempts` times; its failure stays its own, other batches go on. Answers
    are written once (see Answers) and read from there, however often the result is used."""
    return (answers or Answers(requests.sparkSession)).ask(requests, model, round_, batch, attempts)


def review_requests(requests: DataFrame, results: DataFrame, found: DataFrame, round_: int) -> DataFrame:
    """requests (source_id, request) of rows to be looked at again: beside the first request the current result, what
    was found wrong with it, and the round."""
    wrong = found.filter("source_id is not null").groupBy("source_id").agg(F.array_sort(F.collect_set(F.struct("code", "severity"))).alias("issues"))
    now = results.select("source_id", "row_no", F.struct("english_full_name", "korean_attribute_name", "confidence", "evidence").alias("current"))
    rows = requests.join(now, "source_id").join(wrong, "source_id")
    return rows.select("source_id", "row_no", F.to_json(F.struct("request", "current", "issues", F.lit(round_).alias("round"))).alias("request"))


def reviewer(df: DataFrame, dictionary: DataFrame, model: Callable[[pd.DataFrame], Iterable[str]], answers: Answers | None = None, batch: int = 20, attempts: int = 2) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Asks a model about pending rows: a function for review of name_from_dictionary. With the folder of an earlier
    run's answers, what that run had asked isn't asked again."""
    answers = answers or Answers(df.sparkSession)

    def review(todo: DataFrame, found: DataFrame, round_: int) -> DataFrame:
        some = df.join(ids(todo), "source_id", "left_semi")
        requests = encode_requests(some, segment_names(some, dictionary), dictionary)
        asked = review_requests(requests, todo, found, round_)
        return decode_resolutions(propose(asked, model, batch, attempts, answers, round_))[0].select("source_id", "components")

    return review


def decode_resolutions(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers: batch, answer. Resolutions (batch, source_id, components, full_name, korean_attribute_name,
    reason), and the batches whose answer can't be read, with failure_code.

    Keys may be short (id, c, r) or long; a component is an object or a list of four values; names that are
    missing are made from the components."""
    schema = "struct<resolutions:array<struct<id:string,source_id:string,c:array<string>,components:array<string>,full_name:string,korean_attribute_name:string,r:string,reason:string>>>"
    rows = answers.select("batch", X.decode_model_json(F.col("answer"), schema)["resolutions"].alias("found"))
    given = lambda r: F.coalesce(r["c"], r["components"])
    four = lambda c: F.from_json(c, "array<string>")
    named = lambda c: F.from_json(c, "struct<source_fragment:string,full_name:string,korean_word:string,origin:string>")
    listed = lambda c: F.startswith(F.ltrim(c), F.lit("["))
    good = lambda c: F.coalesce(F.when(listed(c), F.size(four(c)) == 4).otherwise(F.startswith(F.ltrim(c), F.lit("{"))), F.lit(False))
    whole = F.col("found").isNotNull() & F.forall("found", lambda r: given(r).isNotNull() & F.forall(given(r), good))
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(False)))

    def component(c):
        texts = [F.when(listed(c), four(c)[i]).otherwise(named(c)[k]) for i, k in enumerate(("source_fragment", "full_name", "korean_word", "origin"))]
        return F.struct(*[F.coalesce(t, F.lit("")).alias(a) for t, a in zip(texts, ("fragment", "full", "korean", "origin"), strict=True)])

    each = rows.filter("whole").select("batch", F.explode("found").alias("r"))
    each = each.select("batch", F.coalesce("r.id", "r.source_id").alias("source_id"), F.transform(given(F.col("r")), component).alias("components"), "r.full_name", "r.korean_attribute_name", F.coalesce("r.r", "r.reason", F.lit("")).alias("reason"))
    full = F.coalesce(F.nullif("full_name", F.lit("")), F.array_join(F.transform("components", lambda c: c["full"]), " "))
    korean = F.coalesce(F.nullif("korean_attribute_name", F.lit("")), F.array_join(F.transform("components", lambda c: c["korean"]), ""))
    return each.withColumns({"full_name": full, "korean_attribute_name": korean}), rows.filter("not whole").select("batch", F.lit("response_error").alias("failure_code"))


NAMED = ("source_id", "row_no", "column_name", "table_name", "table_description", "data_type", "english_full_name", "korean_attribute_name", "evidence", "confidence", "review_stratum", "components")


def naming_rules(dictionary: DataFrame, threshold: int = 85) -> list[Rule]:
    """The rules of names from a dictionary. Those on names and components look at one row, that on contexts at all
    rows of a name in its table."""
    return [
        Rule("names", ("source_id",), lambda r: naming_issues(r, threshold)),
        Rule("components", ("source_id",), lambda r: component_issues(r, r, dictionary)),
        Rule("contexts", CONTEXT, context_findings),
    ]


def name_from_dictionary(df: DataFrame, dictionary: DataFrame, proposals: DataFrame | None = None, review: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None, rounds: int = 0, threshold: int = 85) -> DataFrame:
    """source_id, names, evidence, confidence, review_stratum, status and validation_codes of every row.

    The best segmentation names a row. Rows that it doesn't confirm take an accepted proposal (source_id,
    components) in its place; then, in up to `rounds` rounds, rows with an error or low confidence, what was found
    in them and the round's number are given to review, which gives proposals again (see reviewer). Without proposals
    and review the dictionary alone decides. After a round only what it changed is judged again."""
    own = cut(deterministic_results(df, dictionary).select(*NAMED))
    open_ = ~((F.col("review_stratum") == "deterministic") & (F.col("confidence") >= threshold))
    results = cut(assign_strata(own, threshold=threshold))
    if proposals is not None:
        results = cut(assign_strata(_taken(results, own.filter(open_), df, proposals, dictionary), threshold=threshold))
    rules = naming_rules(dictionary, threshold)
    asked = lambda todo, found, n: _taken(todo, todo, df, review(todo, found, n), dictionary, least=86)
    results, found = review_rounds(results, rules, asked, rounds if review is not None else 0)
    done = apply_status(results, found.filter("source_id is not null"), threshold).select("source_id", "status", "validation_codes")
    return results.drop("components", "row_no").join(merged(done), "source_id")


def repair_names(results: DataFrame, sources: DataFrame, proposals: DataFrame, dictionary: DataFrame, threshold: int = 85) -> DataFrame:
    """Earlier results (see read_results) in which failed rows take accepted proposals, and then strata, rules and status
    of all rows anew: source_id, names, evidence, confidence, review_stratum, status and validation_codes. Ids that
    results and sources don't share raise ValueError."""
    if not missing(results, sources).isEmpty() or not missing(sources, results).isEmpty():
        raise ValueError("source and result ids differ")
    own = ["english_full_name", "korean_attribute_name", "evidence", "confidence", "review_stratum"]
    parts = F.transform("components", lambda c: F.struct(*[c[x].alias(x) for x in ("fragment", "full", "korean", "origin")])).alias("components")
    context = sources.select("source_id", "row_no", *[F.coalesce(c, F.lit("")).alias(c) for c in CONTEXT])
    earlier = context.join(results.select("source_id", *own, parts), "source_id").select(*NAMED)
    failed = results.filter(F.col("status") == FAILED).select("source_id")
    after = cut(assign_strata(cut(_taken(earlier, failed, sources, proposals, dictionary)), threshold=threshold))
    found = judged(after, naming_rules(dictionary, threshold)).filter("source_id is not null")
    done = apply_status(after, found, threshold).select("source_id", "status", "validation_codes")
    return after.select("source_id", *own).join(merged(done), "source_id")


def _taken(results: DataFrame, todo: DataFrame, df: DataFrame, proposals: DataFrame, dictionary: DataFrame, least: int = 0) -> DataFrame:
    """results with accepted proposals for the rows of todo."""
    new = accept_resolution(df, proposals.join(merged(ids(todo)), "source_id", "left_semi"), dictionary).drop("status")
    new = new.withColumn("confidence", F.greatest("confidence", F.lit(least)))
    kept = results.select("source_id", *[c for c in NAMED if c not in new.columns])
    return replace_rows(results.select(*NAMED), kept.join(merged(new), "source_id").select(*NAMED))


def unanswered(requests: DataFrame, resolutions: DataFrame) -> DataFrame:
    """source_id and failure_code of requests that no answer speaks of."""
    return missing(requests, resolutions).select("source_id", F.lit("missing_result").alias("failure_code"))
