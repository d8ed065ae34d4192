"""Names from comments; acceptance of proposals, statuses, corrections and the review loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .core import cut, fan_out, merged, missing, one_row, replace_rows
from .digests import sequence_digest
from .judging import Rule, judged, judged_again
from .terms import Resolver, comment_issues, first_listed, reconcile_terms, units_at_terms

#: Labels of statuses and actions.
CONFIRMED, REVIEW, FAILED = "자동확정", "검토필요", "검증실패"
KEEP, NORMALIZE, REWRITE = "유지", "정규화", "재작성"


def in_order(pos: str, value: Column) -> Column:
    """Aggregate: the values of a group in the order of pos; null values are left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(pos, value.alias("v"))))), lambda x: x["v"])


def semantic_units(c: Column, terms: list[str]) -> Column:
    """c cut at known terms, the longest first; what lies between them stays whole. No terms: c itself."""
    if not terms:
        return F.array(c)
    any_term = "|".join(f"\\Q{t}\\E" for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    units = F.regexp_extract_all(c, F.lit(f"(?s)(?:{any_term})|(?:(?!{any_term}).)+"), 0)
    return F.when(F.size(units) > 0, units).otherwise(F.array(c))


def processing_key(df: DataFrame) -> DataFrame:
    """Adds processing_key: name and description, and the row's context (schema, table, its description, data type, in
    lower case; a column that df lacks counts as empty) too if it needs generation."""
    text = F.col("column_description")
    said = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in df.columns else F.lit("")
    context = F.when(X.classify_risk(text)["requires_generation"], F.struct(*[said(c).alias(c) for c in ("schema_name", "table_name", "table_description", "data_type")]))
    return df.withColumn("processing_key", F.struct(X.normalize_column_name(F.col("column_name")).alias("name"), X.normalize_description_key(text).alias("description"), context.alias("context")))


def deterministic_names(df: DataFrame, glossary: DataFrame) -> DataFrame:
    """df: source_id, column_description; glossary: source, target. The name that fixed policy gives: the
    first alternative of a slash, English from the glossary, no white space or symbols. Columns: source_id,
    original_description, name, action, confidence, unknown (English left), review_reasons, reason.

    Tokens meet the glossary in a join, so that it may have any size. A null description counts as empty."""
    text = F.coalesce("column_description", F.lit(""))
    first = F.when(F.contains(text, F.lit("/")), F.coalesce(F.try_element_at(F.filter(F.split(text, "/"), lambda x: x != ""), F.lit(1)), F.lit(""))).otherwise(text)
    rows = df.select("source_id", text.alias("original_description"))
    pieces = df.select("source_id", F.posexplode_outer(F.regexp_extract_all(first, F.lit("[A-Za-z]+|[^A-Za-z]+"), 0)).alias("pos", "piece"))
    known = glossary.groupBy(F.upper("source").alias("token")).agg(F.min("target").alias("target"))
    found = pieces.withColumn("token", F.upper("piece")).join(known, "token", "left")
    english = F.rlike("piece", F.lit("^[A-Za-z]")) & (F.col("piece") != "ID")
    named = found.groupBy("source_id").agg(
        F.array_join(in_order("pos", F.when(english, F.coalesce("target", "piece")).otherwise(F.col("piece"))), "").alias("name"),
        in_order("pos", F.when(english & F.col("target").isNull(), F.col("piece"))).alias("unknown"),
        in_order("pos", F.when(english & F.col("target").isNotNull(), F.concat(F.lit("영문 "), "piece", F.lit("을 '"), "target", F.lit("'로 한글화")))).alias("translated"),
    )
    #: What a reason says of each step.
    graded = F.regexp_replace("name", "등급등급", "등급")
    compacted = X.compact_whitespace(graded)
    steps = F.array(
        F.when(F.contains("name", F.lit("등급등급")), "중복 접미사 '등급등급'을 '등급'으로 정규화"),
        F.when(compacted != graded, "공백 제거"),
    )
    name = F.regexp_replace(compacted, r"[^\x{AC00}-\x{D7A3}\x{3131}-\x{314E}\x{314F}-\x{3163}A-Za-z0-9]", "")
    cleaned = F.array(F.when(name != compacted, "허용되지 않은 기호 제거"))
    out = rows.join(named.select("source_id", "unknown", "translated", F.concat(steps, cleaned).alias("steps"), name.alias("name")), "source_id")
    alternatives = F.filter(F.split("original_description", "/"), lambda x: x != "")
    dropped = F.when(F.size(alternatives) > 1, F.array_join(F.slice(alternatives, 2, 1 << 30), ", ")).otherwise("확인 불가")
    slash, open_ = F.contains("original_description", F.lit("/")), F.size("unknown") > 0
    changed = (F.col("name") != F.col("original_description")) | open_
    translated = F.size(X.invalid_english_tokens(X.nfkc(F.col("original_description")))) > 0
    why = F.concat(F.array(F.when(slash, F.concat(F.lit("슬래시 대안 중 첫 의미를 임시 선택하고 "), dropped, F.lit(" 제외")))), "translated", "steps")
    return out.select(
        "source_id",
        "original_description",
        "name",
        F.when(~changed, KEEP).when(translated | slash, REWRITE).otherwise(NORMALIZE).alias("action"),
        F.when(~changed, 100).when(open_, 55).when(slash, 85).otherwise(96).alias("confidence"),
        "unknown",
        F.filter(F.array(F.when(slash, F.lit("slash_choice")), F.when(open_, F.lit("unknown_english"))), lambda x: x.isNotNull()).alias("review_reasons"),
        F.when(~changed, "정책을 충족하는 컬럼설명을 원문 그대로 유지").otherwise(F.coalesce(F.nullif(F.array_join(why, "; "), F.lit("")), F.lit("문자 정책에 맞게 정규화"))).alias("reason"),
    )


def ids(df: DataFrame) -> DataFrame:
    return df.select("source_id").filter("source_id is not null").distinct()


def pending_ids(issues: DataFrame) -> DataFrame:
    return ids(issues.filter((F.col("severity") == "error") | (F.col("code") == "low_confidence")))


def not_auto_confirmed(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("status").eqNullSafe(F.lit(CONFIRMED)))


def needs_review(results: DataFrame, issues: DataFrame, decisions: DataFrame | None = None, threshold: int = 90) -> DataFrame:
    """Ids with an error, low confidence, review reasons, a change of meaning, English left or a tied term.
    results: source_id, name, confidence, review_reasons, added_concepts, removed_concepts."""
    own = (F.col("confidence") < threshold) | (F.size("review_reasons") > 0) | (F.size("added_concepts") > 0) | (F.size("removed_concepts") > 0) | (F.size(X.invalid_english_tokens(F.col("name"))) > 0)
    out = ids(issues.filter("severity = 'error'")).unionByName(ids(results.filter(own)))
    return (out if decisions is None else out.unionByName(ids(decisions.filter("tied")))).distinct()


def accept_resolution(sources: DataFrame, proposals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """proposals: source_id, components (structs of fragment, full, korean, origin). Those whose fragments
    rebuild the column name, named; a mapping that the dictionary lacks counts as inference. Of several proposals for
    an id one is looked at."""
    whole = sources.select("source_id", X.compact_identifier(F.col("column_name")).alias("whole"))
    fits = one_row(proposals.select("source_id", "components")).join(merged(whole), "source_id").filter((F.size("components") > 0) & (F.array_join(F.transform("components", lambda c: c["fragment"]), "") == F.col("whole")))
    known = dictionary.select(F.col("abbreviation").alias("fragment"), F.col("full_name").alias("full"), F.col("korean_word").alias("korean")).distinct().withColumn("known", F.lit(True))
    parts = fits.select("source_id", F.posexplode("components").alias("pos", "c")).select("source_id", "pos", "c.*").join(known, ["fragment", "full", "korean"], "left")
    origin = F.when((F.col("origin") == "mapping") & F.col("known").isNull(), "inference").otherwise(F.col("origin"))
    c = parts.groupBy("source_id").agg(in_order("pos", F.struct("fragment", "full", "korean", origin.alias("origin"))).alias("components"))
    inferred = F.exists("components", lambda x: x["origin"] == "inference")
    named = c.select(
        "source_id",
        "components",
        X.join_full_name(F.transform("components", lambda x: x["full"])).alias("english_full_name"),
        X.join_korean_name(F.transform("components", lambda x: F.nullif(x["korean"], F.lit("")))).alias("korean_attribute_name"),
        F.lit(REVIEW).alias("status"),
        F.when(inferred, 76).otherwise(82).alias("confidence"),
        X.evidence_text(F.col("components")).alias("evidence"),
        F.when(inferred, "unmapped_inference").otherwise("mapping_ambiguity").alias("review_stratum"),
    )
    return named.filter((F.col("korean_attribute_name") != "") & ~F.contains("korean_attribute_name", F.lit("미정")) & (F.col("english_full_name") != ""))


def accept(base: DataFrame, proposals: DataFrame, bad_base: DataFrame, bad_proposals: DataFrame, cap: int = 85) -> DataFrame:
    """base with each accepted proposal in place (C06 against deterministic names, C07 against current ones).

    Both: source_id, original_description, name, confidence, review_reasons. bad_*: source_id of rows with any
    issue. A proposal must repeat the description, have no issue, and may not rename a base row without one.
    failure_code: '' if accepted, rejected_result, or missing_result if nothing was proposed."""
    b = base.join(ids(bad_base).withColumn("_bad", F.lit(True)), "source_id", "left")
    p = proposals.join(ids(bad_proposals).withColumn("_odd", F.lit(True)), "source_id", "left")
    p = p.select("source_id", "_odd", *[F.col(c).alias(f"_{c}") for c in ("original_description", "name", "confidence", "review_reasons")], F.lit(True).alias("_has"))
    rows = b.join(p, "source_id", "left")
    ok = F.coalesce(F.col("_has") & F.col("_odd").isNull() & F.col("original_description").eqNullSafe(F.col("_original_description")) & (F.col("_bad").isNotNull() | (F.col("name") == F.col("_name"))), F.lit(False))
    reasons = F.array_distinct(F.concat("review_reasons", "_review_reasons"))
    return rows.select(
        "source_id",
        "original_description",
        F.when(ok, F.col("_name")).otherwise(F.col("name")).alias("name"),
        F.when(~ok, F.col("confidence")).when(F.size(reasons) > 0, F.least("_confidence", F.lit(cap))).otherwise(F.col("_confidence")).alias("confidence"),
        F.when(ok, reasons).otherwise(F.col("review_reasons")).alias("review_reasons"),
        F.when(ok, "").when(F.col("_has"), "rejected_result").otherwise("missing_result").alias("failure_code"),
    )


def batch_response_check(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Both: batch, source_id, description. Batches that must be asked again, with the numbers of duplicate,
    missing and unknown ids and of descriptions that came back changed."""
    key = ["batch", "source_id"]
    got = responses.groupBy(*key).agg(F.count("*").alias("n"), F.min("description").alias("d0"), F.max("description").alias("d1"))
    both = requests.withColumn("asked", F.lit(True)).join(got, key, "full")
    sums = both.groupBy("batch").agg(
        F.count_if(F.expr("n > 1")).alias("duplicates"),
        F.count_if(F.expr("n is null")).alias("missing"),
        F.count_if(F.expr("asked is null")).alias("unknown"),
        F.count_if(F.col("asked").isNotNull() & F.col("n").isNotNull() & ~(F.col("description").eqNullSafe(F.col("d0")) & F.col("description").eqNullSafe(F.col("d1")))).alias("changed"),
    )
    return sums.filter("duplicates + missing + unknown + changed > 0")


def mark_failures(results: DataFrame, failures: DataFrame, cap: int = 85) -> DataFrame:
    """results with confidence capped and a reason added for each failed row. failures: source_id, code."""
    codes = failures.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_set("code")), lambda c: F.concat(F.lit("review:"), c)).alias("_new"))
    rows = results.join(codes, "source_id", "left")
    rows = rows.withColumn("confidence", F.when(F.col("_new").isNull(), F.col("confidence")).otherwise(F.least("confidence", F.lit(cap))))
    return rows.withColumn("review_reasons", F.when(F.col("_new").isNull(), F.col("review_reasons")).otherwise(F.array_distinct(F.concat("review_reasons", "_new")))).drop("_new")


def clear_failures(results: DataFrame) -> DataFrame:
    """results without the reasons that mark_failures adds."""
    return results.withColumn("review_reasons", F.filter("review_reasons", lambda r: ~F.startswith(r, F.lit("review:"))))


def finalize(results: DataFrame, issues: DataFrame, decisions: DataFrame | None = None, threshold: int = 90) -> DataFrame:
    """source_id, confidence, status, codes. Failed on an error or a failure still open (a rejected proposal
    is none); to review on low confidence, reasons, a reported change of meaning, a slash or a tied term, which
    caps confidence at 89. results: source_id, original_description, confidence, review_reasons; added_concepts
    and removed_concepts may be left out."""
    codes = issues.filter("severity = 'error'").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    rows = results.join(codes, "source_id", "left")
    if decisions is not None:
        rows = rows.join(ids(decisions.filter("tied")).withColumn("tied", F.lit(True)), "source_id", "left")
    else:
        rows = rows.withColumn("tied", F.lit(None).cast("boolean"))
    failed = F.exists("review_reasons", lambda r: F.startswith(r, F.lit("review:")) & (r != "review:rejected_result"))
    confidence = F.when(F.col("tied"), F.least("confidence", F.lit(89))).otherwise(F.col("confidence"))
    doubt = (confidence < threshold) | (F.size("review_reasons") > 0) | F.contains("original_description", F.lit("/")) | F.col("tied").isNotNull()
    for c in ("added_concepts", "removed_concepts"):
        if c in results.columns:
            doubt = doubt | (F.coalesce(F.size(c), F.lit(0)) > 0)
    status = F.when(F.col("codes").isNotNull() | failed, FAILED).when(doubt, REVIEW).otherwise(CONFIRMED)
    return rows.select("source_id", confidence.alias("confidence"), status.alias("status"), F.coalesce("codes", F.lit("")).alias("codes"))


MOST_ROUNDS = 5


def _replaced(results: DataFrame, waiting: DataFrame, proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results with one new row for each waiting id that was proposed for, and the new rows. What was proposed is
    worked out once: it may come from a model, and must be the same for what goes and what comes."""
    new = cut(one_row(proposed.join(merged(waiting), "source_id", "left_semi").select(*results.columns)))
    return cut(replace_rows(results, new)), new


def review_loop(results: DataFrame, pending: Callable[[DataFrame], DataFrame], propose: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """Up to `rounds` (5 at most) rounds: pending picks the ids that need work, propose gives new rows for
    them, which replace the old ones. Only pending rows are proposed for, of several rows for an id one is taken, and
    each round's result is written."""
    for _ in range(min(rounds, MOST_ROUNDS)):
        waiting = cut(ids(pending(results)))
        if waiting.isEmpty():
            break
        results, _ = _replaced(results, waiting, propose(results.join(merged(waiting), "source_id", "left_semi")))
    return results


def review_rounds(results: DataFrame, rules: list[Rule], propose: Callable[[DataFrame, DataFrame, int], DataFrame], rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """The same with rules that pick the ids: results and their findings. propose gets the pending rows, their findings
    and the number of the round, from 1. After a round only what its new rows touch is judged again."""
    found = cut(judged(results, rules))
    for n in range(1, min(rounds, MOST_ROUNDS) + 1):
        waiting = cut(pending_ids(found))
        if waiting.isEmpty():
            break
        todo = results.join(merged(waiting), "source_id", "left_semi")
        after, new = _replaced(results, waiting, propose(todo, found.join(merged(waiting), "source_id", "left_semi"), n))
        found = cut(judged_again(found, results, after, new, rules))
        results = after
    return results, found


def apply_corrections(results: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results with checked corrections in place, and the issues of the others: duplicate_correction,
    unknown_source_id, invalid_correction. corrections: source_id, english_full_name, korean_attribute_name,
    confidence (88 if null). A corrected name is one inference component and goes to review."""
    full, korean = X.upper_trim(F.col("english_full_name")), X.compact_whitespace(F.col("korean_attribute_name"))
    counts = corrections.groupBy("source_id").agg(F.count("*").alias("n"))
    new = corrections.select("source_id", full.alias("english_full_name"), korean.alias("korean_attribute_name"), F.coalesce("confidence", F.lit(88)).alias("confidence")).join(counts, "source_id")
    new = new.join(results.select("source_id", "column_name"), "source_id", "left")
    valid = F.coalesce(F.col("english_full_name") != "", F.lit(False)) & X.is_valid_name(F.col("korean_attribute_name"))
    code = F.when(F.col("n") > 1, "duplicate_correction").when(F.col("column_name").isNull(), "unknown_source_id").when(~valid, "invalid_correction")
    new = new.withColumn("code", code)
    good = new.filter("code is null").withColumn("evidence", F.concat(X.compact_identifier(F.col("column_name")), F.lit("→"), "english_full_name", F.lit("→"), "korean_attribute_name", F.lit("[inference]")))
    good = good.select("source_id", "column_name", "english_full_name", "korean_attribute_name", "confidence", "evidence", F.lit(REVIEW).alias("status"))
    old = results.select(*good.columns)
    return replace_rows(old, good), new.filter("code is not null").select("source_id", "code").distinct()


def read_results(df: DataFrame) -> DataFrame:
    """Earlier results with their components back from the evidence; without any, one inference component of
    the whole name. df: source_id, column_name, english_full_name, korean_attribute_name, status, confidence, evidence."""
    whole = X.compact_identifier(F.col("column_name"))
    found = X.parse_evidence(F.coalesce("evidence", F.lit("")))
    one = F.array(F.struct(whole.alias("fragment"), F.coalesce(F.nullif("english_full_name", F.lit("")), whole).alias("full"), F.coalesce(F.nullif("korean_attribute_name", F.lit("")), F.lit("미정")).alias("korean"), F.lit("inference").alias("origin"), F.lit(0).alias("start"), F.length(whole).alias("end")))
    rows = df.withColumn("components", F.when(F.size(found) > 0, found).otherwise(one))
    inferred = F.exists("components", lambda c: c["origin"] == "inference")
    return rows.withColumn("review_stratum", F.when(inferred, "unmapped_inference").when(F.col("status") == CONFIRMED, "deterministic").otherwise("mapping_ambiguity"))


def repair_failed(results: DataFrame, sources: DataFrame, proposals: DataFrame, dictionary: DataFrame) -> DataFrame:
    """results, in which failed rows are replaced by accepted proposals; others stay. Ids that results and
    sources don't share raise ValueError."""
    if not missing(results, sources).isEmpty() or not missing(sources, results).isEmpty():
        raise ValueError("source and result ids differ")
    failed = results.filter(F.col("status") == FAILED)
    new = accept_resolution(sources, proposals.join(ids(failed), "source_id", "left_semi"), dictionary)
    cols = ["source_id", "english_full_name", "korean_attribute_name", "status", "confidence", "evidence"]
    return replace_rows(results.select(*cols), new.select(*cols))


def resolution_requests(segments: DataFrame, dictionary: DataFrame, k: int = 4) -> DataFrame:
    """segments: column_name, table_name, rank, fragments. The first k candidates of each name and all senses
    of their fragments and of the whole name."""
    key = ["column_name", "table_name"]
    few = segments.groupBy(*key).agg(F.slice(in_order("rank", F.array_join("fragments", "|")), 1, k).alias("candidates"))
    parts = segments.select(*key, F.explode("fragments").alias("fragment")).unionByName(segments.select(*key, X.compact_identifier(F.col("column_name")).alias("fragment"))).distinct()
    senses = dictionary.groupBy(F.col("abbreviation").alias("fragment")).agg(F.array_sort(F.collect_set(F.concat_ws("→", "full_name", "korean_word"))).alias("senses"))
    options = parts.join(senses, "fragment").groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fragment", "senses")))).alias("options"))
    return few.join(options, key, "left")


def review_strata(results: DataFrame) -> DataFrame:
    """One row for each (name, description): the first row's id and strata, and how often the key occurs.
    results: row_no, source_id, column_name, column_description, action, status, confidence, terms (boolean).

    Names' descriptions and keys' rows are counted by partial aggregates, not in windows."""
    keyed = results.withColumns({"k0": F.upper(X.trim_all(F.coalesce("column_name", F.lit("")))), "k1": X.trim_all(F.coalesce("column_description", F.lit("")))})
    cols = ["row_no", "source_id", "column_description", "action", "status", "confidence", "terms"]
    firsts = keyed.groupBy("k0", "k1").agg(F.min_by(F.struct(*cols), "row_no").alias("r"), F.count("*").alias("occurrence_count"))
    many = firsts.groupBy("k0").agg((F.count("*") > 1).alias("many"))
    rows = firsts.join(many, "k0").select("r.*", "occurrence_count", "many")
    text = F.coalesce("column_description", F.lit(""))
    tests = {
        "duplicate_context": (F.col("occurrence_count") > 1) | F.col("many"),
        "english_translation": F.rlike(F.regexp_replace(text, "ID", ""), F.lit("[A-Za-z]")),
        "llm_rewrite": F.col("action") == REWRITE,
        "numeric_preservation": F.rlike(text, F.lit("[0-9]")),
        "review_needed": ~F.col("status").eqNullSafe(F.lit(CONFIRMED)) | (F.coalesce("confidence", F.lit(0)) < 90),
        "slash_context": F.contains(text, F.lit("/")),
        "terminology_frequency": F.coalesce("terms", F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    strata = F.when(F.size(found) > 0, found).when(F.col("action") == KEEP, F.array(F.lit("low_risk_keep"))).otherwise(F.array(F.lit("other")))
    return rows.select("source_id", "occurrence_count", strata.alias("review_strata"))


def failure_text(code: Column) -> Column:
    """The label of a failure code."""
    #: Fixed values.
    labels = {"timeout": "시간 초과", "connection_error": "연결 실패", "response_error": "응답 형식 오류", "model_error": "호출 실패", "missing_result": "결과 누락", "rejected_result": "정책 검증 거부", "unexpected_error": "예상하지 못한 오류"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code], F.lit("실패"))


def recovery_stats(events: DataFrame, weights: DataFrame) -> DataFrame:
    """events: source_id, stage, round, code ('' where the row succeeded). Of each stage and code the weighted failures
    and the sources that ever had it, beside the sources and rows that it is open for: those whose last round in the
    stage ended with it. Rejections are told apart. An event that comes again counts again, but is one last event."""
    rows = events.join(weights, "source_id")
    failed = rows.filter("code != ''").groupBy("stage", "code", "source_id").agg(F.count("*").alias("n"), F.min("weight").alias("weight"))
    ever = failed.groupBy("stage", "code").agg(F.sum(F.col("n") * F.col("weight")).alias("failures"), F.sum("weight").alias("sources"))
    last = rows.groupBy("stage", "source_id").agg(F.max(F.struct("round", "code")).alias("e"), F.min("weight").alias("weight")).filter("e.code != ''")
    still = last.groupBy("stage", F.col("e.code").alias("code")).agg(F.sum("weight").alias("open_sources"), F.count("*").alias("open_rows"))
    return ever.join(still, ["stage", "code"], "left").fillna(0, ["open_sources", "open_rows"]).withColumn("rejection", F.col("code") == "rejected_result")


def recovery_events(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """One event for each row that a failed representative stands for. aliases: source_id, representative."""
    return events.withColumnRenamed("source_id", "representative").join(aliases.select("source_id", "representative"), "representative").select("source_id", "stage", "round", "code")


def _hashed_decisions(decisions: DataFrame) -> DataFrame:
    """decisions with their frequencies as JSON, in the order of their terms, and decision_hash, which names what was
    decided."""
    rows = decisions.withColumn("frequencies", F.to_json(F.array_sort(F.map_entries("frequencies"))))
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("group_id", "selected_term", "frequencies", "tied", "selection_source")]
    return rows.withColumn("decision_hash", F.sha2(F.array_join(F.array(*said), chr(0)), 256))


def decision_rollup(decisions: DataFrame) -> DataFrame:
    """decisions: source_id, group_id, selected_term, frequencies (map), tied, selection_source. One row for
    each different decision, with its hash, the number of its sources and their first and last id; decision_members
    has them all."""
    rows = _hashed_decisions(decisions)
    return rows.groupBy("decision_hash", "group_id", "selected_term", "frequencies", "tied", "selection_source").agg(F.count_distinct("source_id").alias("n_sources"), F.min("source_id").alias("first_id"), F.max("source_id").alias("last_id"))


def decision_members(decisions: DataFrame) -> DataFrame:
    """decision_hash and source_id: each id that a decision affects, once. A table, as they may be more than fit in a row."""
    return _hashed_decisions(decisions).select("decision_hash", "source_id").distinct()


def lock_manifest(manifest: DataFrame, stage: str) -> DataFrame:
    """One row that locks a manifest (pos, source_id): stage, n, and sha256 over its rows in order."""
    return sequence_digest(manifest, "pos", "source_id").select(F.lit(stage).alias("stage"), "n", "sha256")


def locked_sample(population: DataFrame, manifest: DataFrame, lock: DataFrame | None = None, stage: str | None = None) -> DataFrame:
    """population rows in the manifest's order (pos, source_id). ValueError for a lock of another stage, a manifest that
    isn't the one that was locked, or a listed id that is gone."""
    if lock is not None:
        said, is_ = lock.first(), lock_manifest(manifest, stage or "").first()
        if stage is not None and said["stage"] != stage:
            raise ValueError(f"locked for stage {said['stage']}, not {stage}")
        if (said["n"], said["sha256"]) != (is_["n"], is_["sha256"]):
            raise ValueError("the manifest isn't the one that was locked")
    if gone := [r["source_id"] for r in missing(manifest, population).limit(5).collect()]:
        raise ValueError(f"missing from the population: {', '.join(gone)}")
    return population.join(F.broadcast(manifest) if manifest.count() <= 10_000 else manifest, "source_id").orderBy("pos")


def name_from_comments(df: DataFrame, glossary: DataFrame, synonyms: DataFrame | None = None, proposals: DataFrame | None = None, resolver: Resolver | None = first_listed, threshold: int = 90) -> DataFrame:
    """source_id, name, action, reason, confidence, status, codes for every row.

    Each different processing key is named once, by its first row: by policy, then by an accepted proposal
    (source_id, original_description, name, confidence, review_reasons), then with unified terms, whose
    frequencies are those of the policy's names. The result is copied to all rows of the key, and every row is
    checked against its own description."""
    keyed = processing_key(df).select("source_id", "row_no", F.to_json("processing_key").alias("_key"))
    firsts = keyed.groupBy("_key").agg(F.min_by("source_id", "row_no").alias("representative"), F.count("*").alias("weight"))
    aliases = cut(keyed.join(firsts, "_key").select("source_id", "representative", "weight"))
    first = df.join(ids(aliases.select(F.col("representative").alias("source_id"))), "source_id", "left_semi")
    named = deterministic_names(first, glossary)
    policy = named
    if proposals is not None:
        issues_of = lambda r: comment_issues(r.withColumn("column_description", F.col("original_description")))
        named = cut(named)
        checked = named.select("source_id", "action", "reason").join(proposals, "source_id")
        taken = accept(named, proposals, issues_of(named), issues_of(checked)).select("source_id", "name", "confidence", "review_reasons", "failure_code")
        old = named.select("source_id", "original_description", "action", "reason", F.col("name").alias("_policy"))
        renamed = F.col("name") != F.col("_policy")
        named = old.join(taken, "source_id").withColumn("action", F.when(renamed, REWRITE).otherwise(F.col("action"))).drop("_policy", "failure_code")
    decisions = None
    if synonyms is not None:
        weights = aliases.filter("source_id = representative").select("source_id", "weight")
        parted = lambda r: cut(units_at_terms(cut(r), synonyms).join(weights, "source_id"))
        around, units = first.select("source_id", "table_name", "table_description"), parted(policy)
        now = parted(named) if proposals is not None else units
        named, decisions = reconcile_terms(now.join(around, "source_id"), synonyms, units, resolver)
        decisions = fan_out(decisions, aliases)
    every = fan_out(named.drop("original_description", "weight", "table_name", "table_description"), aliases)
    every = every.join(df.select("source_id", "column_description", F.coalesce("column_description", F.lit("")).alias("original_description")), "source_id")
    issues = comment_issues(every.withColumn("column_description", F.col("original_description")))
    done = finalize(every, issues, decisions, threshold)
    return every.select("source_id", "name", "action", "reason").join(done, "source_id")
