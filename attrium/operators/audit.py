"""Rules and audits that look across results: components, contexts, sets, terms, statuses, preservation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .core import issue, merged, missing, required_minus_present, union_issues
from .matching import find_terms


def component_issues(sources: DataFrame, results: DataFrame, dictionary: DataFrame) -> DataFrame:
    """results: source_id, components, evidence. Fragments that don't rebuild the name, components without
    meaning, mappings that the dictionary lacks, evidence that doesn't show a component."""
    rows = results.join(merged(sources.select("source_id", X.compact_identifier(F.col("column_name")).alias("whole"))), "source_id")
    each = rows.select("source_id", "evidence", F.explode("components").alias("c")).select("source_id", "evidence", "c.*")
    known = dictionary.select(F.col("abbreviation").alias("fragment"), F.col("full_name").alias("full"), F.col("korean_word").alias("korean")).distinct()
    token = F.concat("fragment", F.lit("→"), "full", F.lit("→"), "korean")
    empty = F.lit("")
    return union_issues(
        issue(rows.filter(F.array_join(F.transform("components", lambda c: c["fragment"]), "") != F.col("whole")), "component_coverage_mismatch", details=F.col("whole")),
        issue(each.filter((F.coalesce("full", empty) == "") | (F.coalesce("korean", empty) == "")), "empty_component_meaning", details=F.col("fragment")),
        issue(each.filter("origin = 'mapping'").join(known, ["fragment", "full", "korean"], "left_anti"), "mapping_evidence_mismatch", details=F.col("fragment")),
        issue(each.filter(~F.coalesce(F.contains("evidence", token), F.lit(False))), "evidence_mismatch", details=F.col("fragment")),
    )


CONTEXT = ["column_name", "table_name", "table_description", "data_type"]


def context_findings(rows: DataFrame) -> DataFrame:
    """Contexts (name, table, its description, type) with more than one result, and what is found: code, severity."""
    pairs = rows.select(*CONTEXT, "english_full_name", "korean_attribute_name").distinct()
    return pairs.groupBy(*CONTEXT).agg(F.count("*").alias("n_values")).filter("n_values > 1").select(*CONTEXT, F.lit("inconsistent_context_result").alias("code"), F.lit("error").alias("severity"), F.concat_ws(" / ", *CONTEXT).alias("details"))


def context_issues(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Contexts with more than one result. No source_id: a finding on the whole, which changes no row's status."""
    rows = sources.select("source_id", *CONTEXT).join(results.select("source_id", "english_full_name", "korean_attribute_name"), "source_id")
    return context_findings(rows).select(F.lit(None).cast("string").alias("source_id"), "code", "severity", "details")


def set_issues(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Ids that are listed twice on either side, unknown or missing."""
    twice = lambda df: df.groupBy("source_id").count().filter("count > 1")
    return union_issues(
        issue(twice(sources), "duplicate_source_id"),
        issue(twice(results), "duplicate_result"),
        issue(missing(results, sources).select("source_id").distinct(), "unknown_source_id"),
        issue(missing(sources, results).select("source_id").distinct(), "missing_result"),
    )


def order_issues(sources: DataFrame, results: DataFrame) -> DataFrame:
    """row_count_mismatch and row_order_changed, one row each at most; both tables have row_no."""
    n = lambda df: df.agg(F.count("*").alias("n"))
    sizes = n(sources).select(F.lit(1).alias("k"), F.col("n").alias("a")).join(n(results).select(F.lit(1).alias("k"), F.col("n").alias("b")), "k").filter("a != b")
    moved = sources.select("source_id", F.col("row_no").alias("a")).join(results.select("source_id", F.col("row_no").alias("b")), "source_id").filter("a != b").limit(1)
    row = lambda df, code: df.select(F.lit(None).cast("string").alias("source_id"), F.lit(code).alias("code"), F.lit("error").alias("severity"))
    return row(sizes, "row_count_mismatch").unionByName(row(moved, "row_order_changed"))


def duplicate_inconsistent(keyed: DataFrame) -> DataFrame:
    """keyed: source_id, key, name. Every row of a key that has several names."""
    bad = keyed.select("key", "name").distinct().groupBy("key").count().filter("count > 1").select("key")
    return issue(keyed.join(bad, "key", "left_semi"), "duplicate_input_inconsistent")


def terminology_issues(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """results: source_id, units; decisions: source_id, candidates, selected_term. Decisions on unknown rows,
    and rows that still hold another candidate than the selected one."""
    own = decisions.filter("source_id is not null")
    rows = own.join(results.select("source_id", "units"), "source_id")
    present = F.array_intersect("units", "candidates")
    return issue(missing(own, results), "terminology_unknown_source").unionByName(issue(rows.filter(F.exists(present, lambda t: t != F.col("selected_term"))), "terminology_decision_mismatch"))


def status_issues(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows whose status or codes differ from those computed anew. Both: source_id, status, codes."""
    rows = results.join(expected.select("source_id", F.col("status").alias("_s"), F.col("codes").alias("_c")), "source_id")
    return issue(rows.filter(~F.col("status").eqNullSafe(F.col("_s"))), "status_mismatch").unionByName(issue(rows.filter(~F.col("codes").eqNullSafe(F.col("_c"))), "validation_issue_codes_mismatch"))


def positional_join(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """row_no with, for each of cols, whether the two agree; '' and null are the same. One side only: false."""
    x = a.select("row_no", F.lit(True).alias("_x"), *[F.col(c).alias(f"_a_{c}") for c in cols])
    y = b.select("row_no", F.lit(True).alias("_y"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return x.join(y, "row_no", "full").select("row_no", *[(both & blank(f"_a_{c}").eqNullSafe(blank(f"_b_{c}"))).alias(c) for c in cols])


def preservation(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, rows with a changed cell and changed cells of the original columns."""
    changed = reduce(lambda s, c: s + (~F.col(c)).cast("int"), cols, F.lit(0))
    return positional_join(a, b, cols).agg(F.count("*").alias("n_rows"), F.count_if(changed > 0).alias("changed_rows"), F.sum(changed).cast("long").alias("changed_cells"))


def result_audit(results: DataFrame) -> DataFrame:
    """Counts of blank, invalid and placeholder values, and of results of each status."""
    full, name = F.trim(F.coalesce("english_full_name", F.lit(""))), F.trim(F.coalesce("korean_attribute_name", F.lit("")))
    return results.agg(
        F.count("*").alias("n_rows"),
        F.count_if(full == "").alias("blank_full_name"),
        F.count_if(name == "").alias("blank_korean_name"),
        F.count_if((name != "") & ~X.is_valid_name(name)).alias("invalid_korean_name"),
        F.count_if(F.rlike(name, F.lit("미정|불명|알수없음"))).alias("placeholder_name"),
        F.count_if(F.trim(F.coalesce("evidence", F.lit(""))) == "").alias("blank_evidence"),
        F.count_if(~F.coalesce(F.col("confidence").between(0, 100), F.lit(False))).alias("confidence_out_of_range"),
        *[F.count_if(F.col("status") == s).alias(a) for s, a in (("자동확정", "confirmed"), ("검토필요", "to_review"), ("검증실패", "failed"))],
    )


def integrity_checks(found: dict[str, DataFrame]) -> DataFrame:
    """Named checks: name, passed and number of failures, from the rows that fail each."""
    return union_issues(*[df.agg(F.count("*").alias("failures")).select(F.lit(k).alias("name"), (F.col("failures") == 0).alias("passed"), "failures") for k, df in found.items()])


def reference_accuracy(results: DataFrame, reference: DataFrame) -> DataFrame:
    """results: column_name, name; reference: column_name, reference. Rows compared, equal ones and their share."""
    rows = results.join(reference, "column_name")
    same = F.col("name").eqNullSafe(F.col("reference"))
    return rows.agg(F.count("*").alias("compared"), F.count_if(same).alias("exact"), F.round(F.avg(same.cast("double")), 6).alias("rate"))


def token_overlap(a: Column, b: Column) -> Column:
    """Whether two names share a token of letters and digits."""
    tokens = lambda c: F.filter(F.split(F.upper(c), "[^A-Z0-9]+"), lambda x: x != "")
    return F.coalesce(F.arrays_overlap(tokens(a), tokens(b)), F.lit(False))


def score_observations(ratings: DataFrame, rubric: DataFrame, facts: DataFrame, passing: float = 90, least: float = 3.5) -> DataFrame:
    """One row for each review. ratings: review, dimension, rating; rubric: id, weight; facts: review, critical
    (issues), failed_checks, reviewed, expected. The weighted score is capped at 69 by a critical issue and at
    59 by a failed check, which an incomplete review counts as."""
    sums = ratings.join(rubric, ratings["dimension"] == rubric["id"]).groupBy("review").agg(F.sum(F.col("weight") * F.col("rating") / 5).alias("raw"), F.min("rating").alias("lowest"))
    bad = (F.col("failed_checks") > 0) | (F.col("reviewed") != F.col("expected")) | (F.col("expected") <= 0)
    score = F.round(F.least("raw", F.when(F.col("critical") > 0, 69.0), F.when(bad, 59.0)), 2)
    return sums.join(facts, "review").select("review", F.round("raw", 2).alias("raw"), score.alias("score"), ((score >= passing) & (F.col("lowest") >= least) & (F.col("critical") == 0) & ~bad).alias("passed"))


def description_evidence(candidates: DataFrame, sources: DataFrame, word: str = "korean_word", texts: tuple[str, ...] = ("column_description", "table_description")) -> DataFrame:
    """Candidates of which the word, without spaces and the like, stands in one of their source's texts."""
    rows = candidates.join(sources.select("source_id", *texts), "source_id")
    key = X.normalize_korean_key(F.col(word))
    said = reduce(lambda a, c: a | F.coalesce(F.contains(X.normalize_korean_key(F.col(c)), key), F.lit(False)), texts, F.lit(False))
    return rows.filter((key != "") & said).select(*candidates.columns)


def references(commented: DataFrame) -> DataFrame:
    """column_name and reference: the comment of names that have exactly one, and how many rows have it."""
    per = commented.groupBy("column_name", "column_description").agg(F.count("*").alias("n"))
    return per.groupBy("column_name").agg(F.count("*").alias("k"), F.min("column_description").alias("reference"), F.sum("n").alias("n")).filter("k = 1").drop("k")


def terminology_audit(sources: DataFrame, names: DataFrame, synonyms: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions checked against the texts: group_id and code.

    sources: source_id, column_description; names: source_id, name; decisions: group_id, selected_term,
    frequencies (map), tied. Each group's candidates are counted anew in the descriptions, longest first.
    frequency_mismatch, tie_mismatch, selected_not_most_frequent, group_missing (it occurs, but nothing was
    decided), candidates_mismatch (frequencies are of other terms than the rules'), selected_term_absent (no name holds
    it)."""
    each = find_terms(sources, synonyms)
    counts = synonyms.select("group_id", "candidate").distinct().join(each.groupBy("group_id", "candidate").agg(F.count("*").alias("n")), ["group_id", "candidate"], "left").fillna(0)
    groups = counts.groupBy("group_id").agg(F.max("n").alias("top"))
    winners = counts.join(groups, "group_id").filter("n = top").groupBy("group_id").agg(F.count("*").alias("k"))
    decided = decisions.select("group_id", "selected_term", "tied").join(groups, "group_id").join(winners, "group_id")
    said = decisions.select("group_id", F.explode("frequencies").alias("candidate", "said")).withColumn("listed", F.lit(True))
    both = counts.join(decisions.select("group_id").distinct(), "group_id", "left_semi").withColumn("ruled", F.lit(True)).join(said, ["group_id", "candidate"], "full")
    row = lambda df, code: df.select("group_id", F.lit(code).alias("code"))
    selected = decisions.select("group_id", F.col("selected_term").alias("candidate"))
    chosen = selected.join(counts, ["group_id", "candidate"], "left").join(groups, "group_id")
    terms = selected.join(groups, "group_id", "left_semi").distinct()
    held = find_terms(names, terms.select("candidate", F.col("candidate").alias("group_id")), "name").select("candidate").distinct()
    return (
        row(both.filter("ruled and listed and n != said"), "frequency_mismatch")
        .unionByName(row(both.filter("ruled is null or listed is null").join(groups, "group_id", "left_semi"), "candidates_mismatch"))
        .unionByName(row(decided.filter(F.col("tied") != (F.col("k") > 1)), "tie_mismatch"))
        .unionByName(row(chosen.filter("n is null or n != top"), "selected_not_most_frequent"))
        .unionByName(row(required_minus_present(groups.filter("top > 0"), decisions, "group_id"), "group_missing"))
        .unionByName(row(terms.join(held, "candidate", "left_anti"), "selected_term_absent"))
        .distinct()
    )


def affected_issues(sources: DataFrame, names: DataFrame, synonyms: DataFrame, decisions: DataFrame, affected: DataFrame) -> DataFrame:
    """The rows that decisions say they affect, checked against the texts: group_id, source_id and code.

    affected: group_id, source_id, a row for each. affected_missing (its description holds a candidate, but it isn't
    listed), affected_extra (listed, and it doesn't), affected_twice, affected_unknown (no such name),
    selected_term_absent (listed, and its name doesn't hold the selected term)."""
    key = ["group_id", "source_id"]
    listed = affected.groupBy(*key).agg(F.count("*").alias("n"))
    anew = find_terms(sources, synonyms).select(*key).distinct()
    row = lambda df, code: df.select(*key, F.lit(code).alias("code"))
    decided = decisions.select("group_id").distinct()
    known = listed.join(names.select("source_id", "name"), "source_id").join(decisions.select("group_id", "selected_term"), "group_id")
    return (
        row(anew.join(decided, "group_id", "left_semi").join(listed, key, "left_anti"), "affected_missing")
        .unionByName(row(listed.join(anew, key, "left_anti"), "affected_extra"))
        .unionByName(row(listed.filter("n > 1"), "affected_twice"))
        .unionByName(row(missing(listed, names), "affected_unknown"))
        .unionByName(row(known.filter(~F.coalesce(F.contains("name", F.col("selected_term")), F.lit(False))), "selected_term_absent"))
    )


def header_issues(original: list[str], result: list[str]) -> list[tuple[str, str]]:
    """What happened to the headers of a table: (code, header). header_missing, header_case_changed, header_moved, and
    header_inserted for one that was added before the end of the originals; what is added after them is fine."""
    at = {h: i for i, h in enumerate(result)}
    lower = {h.lower(): h for h in reversed(result)}
    out, seen = [], []
    for h in original:
        if h in at:
            seen.append(at[h])
        elif h.lower() in lower and lower[h.lower()] not in original:
            out.append(("header_case_changed", h))
            seen.append(at[lower[h.lower()]])
        else:
            out.append(("header_missing", h))
    kept = set(seen)
    for k, (h, i) in enumerate(zip([h for h in original if ("header_missing", h) not in out], seen, strict=True)):
        if sorted(seen)[k] != i:
            out.append(("header_moved", h))
    out += [("header_inserted", h) for i, h in enumerate(result) if i not in kept and seen and i < max(seen)]
    return out


#: Labels of statuses, and of what was done to a name.
STATUSES, METHODS = ("자동확정", "검토필요", "검증실패"), ("유지", "정규화", "재작성")
CHECKS = ("row_preservation", "required_columns_complete", "character_policy_complete", "numeric_preservation_complete", "evidence_traceable", "duplicate_consistency", "terminology_frequency_verified")
RESULT = ("name", "action", "confidence", "status", "reason", "review_reason")


def integrity_audit(sources: DataFrame, results: DataFrame, synonyms: DataFrame, decisions: DataFrame, affected: DataFrame) -> DataFrame:
    """check, code, severity and source_id (null if it is about the whole) of all that is wrong with results.

    sources: source_id, column_name, column_description and more; results: the columns of sources, then RESULT.
    A result column that is missing is told, and what needs it isn't looked at. decisions and affected: see
    terminology_audit and affected_issues."""
    spark, originals = sources.sparkSession, sources.columns
    found: list[DataFrame] = []

    def add(check: str, df: DataFrame, code: str | Column, severity: str | Column) -> None:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        found.append(df.select(F.lit(check).alias("check"), as_column(code).alias("code"), as_column(severity).alias("severity"), "source_id"))

    def whole(check: str, codes: list[str], severity: str = "critical") -> None:
        add(check, spark.createDataFrame([(c,) for c in codes], "code string").withColumn("source_id", F.lit(None).cast("string")), F.col("code"), severity)

    whole(CHECKS[0], [code for code, _ in header_issues(originals, results.columns)])
    n = lambda df: df.agg(F.count("*").alias("n"))
    size = n(sources).withColumn("k", F.lit(1)).join(n(results).select(F.lit(1).alias("k"), F.col("n").alias("m")), "k").filter("n != m")
    add(CHECKS[0], size.withColumn("source_id", F.lit(None).cast("string")), "row_count_mismatch", "critical")
    absent = [c for c in RESULT if c not in results.columns]
    whole(CHECKS[1], absent + [f"source {c}" for c in ("column_name", "column_description") if c not in originals])
    kept = [c for c in originals if c != "source_id" and c in results.columns]
    both = sources.select("source_id", *[F.col(c).alias(f"_{c}") for c in kept]).join(results, "source_id")
    changed = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in kept])
    add(CHECKS[0], both.select("source_id", F.explode(F.array_compact(changed)).alias("column")), "value_changed", "critical")
    if not absent and {"column_name", "column_description"} <= set(kept):
        text, name = F.coalesce("_column_description", F.lit("")), F.coalesce("name", F.lit(""))
        add(CHECKS[2], both.filter(~F.coalesce(X.is_valid_name(name, "audit"), F.lit(False))), F.when(name == "", "empty_name").otherwise("invalid_name"), F.when(name == "", "critical").otherwise("major"))
        add(CHECKS[3], both.filter(~X.digits_preserved(text, name)), "numbers_changed", "critical")
        status, method, why = F.coalesce("status", F.lit("")), F.coalesce("action", F.lit("")), lambda c: X.trim_all(F.coalesce(c, F.lit("")))
        tests = {
            "invalid_status": ~status.isin(*STATUSES),
            "invalid_method": ~method.isin(*METHODS),
            "confidence_out_of_range": ~F.coalesce(F.expr("try_cast(confidence AS int)").between(0, 100), F.lit(False)),
            "keep_result_changed": (method == METHODS[0]) & (name != text),
            "change_reason_missing": method.isin(*METHODS[1:]) & (why("reason") == ""),
            "review_reason_missing": (status != STATUSES[0]) & (why("review_reason") == ""),
            "review_reason_unexpected": (status == STATUSES[0]) & (why("review_reason") != ""),
        }
        codes = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
        add(CHECKS[4], both.select("source_id", F.explode(codes).alias("code")), F.col("code"), F.when(F.col("code") == "review_reason_unexpected", "minor").otherwise("major"))
        key = F.to_json(F.struct(X.normalize_column_name(F.col("_column_name")).alias("a"), X.normalize_description_key(text).alias("b")))
        names = both.select(key.alias("key"), name.alias("name")).distinct().groupBy("key").count().filter("count > 1")
        add(CHECKS[5], names.withColumn("source_id", F.lit(None).cast("string")), "inconsistent_names", "major")
        own = results.select("source_id", "name")
        add(CHECKS[6], terminology_audit(sources, own, synonyms, decisions).filter("code != 'selected_term_absent'").withColumn("source_id", F.lit(None).cast("string")), F.col("code"), "major")
        add(CHECKS[6], affected_issues(sources, own, synonyms, decisions, affected), F.col("code"), "major")
    return union_issues(*found)


def integrity_summary(found: DataFrame) -> DataFrame:
    """name, passed and failures of each of the seven checks."""
    names = found.sparkSession.createDataFrame([(c,) for c in CHECKS], "name string")
    counts = found.groupBy(F.col("check").alias("name")).agg(F.count("*").alias("failures"))
    rows = names.join(counts, "name", "left").fillna(0)
    return rows.select("name", (F.col("failures") == 0).alias("passed"), "failures")
