"""Queries of the operators on names, proposals, audits and statuses; adds them to those of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators import audit, core, dictionary as D, digests, naming as N
from .queries import ISSUES, ORACLES, QUERIES, _query, desc

__all__ = ["ORACLES", "QUERIES"]


def every(n: int, rest: int = 0) -> Column:
    return F.col("row_no") % n == rest


def glossary(k: DataFrame) -> DataFrame:
    """Senses of words but RED's, so that some English stays."""
    return k.filter("word <> 'RED'").select(F.col("word").alias("source"), F.col("korean").alias("target"))


def proposals(c: DataFrame, k: DataFrame) -> DataFrame:
    """Components of each name; every 7th with full names that the dictionary lacks, every 11th cut short."""
    each = c.select("source_id", "row_no", F.posexplode(F.split("column_name", "_")).alias("pos", "word")).join(k, "word")
    full = F.when(every(7), F.concat("word", F.lit("S"))).otherwise(F.col("word"))
    part = F.struct(F.col("word").alias("fragment"), full.alias("full"), "korean", F.lit("mapping").alias("origin"))
    return each.filter(~every(11) | (F.col("pos") == 0)).groupBy("source_id").agg(N.in_order("pos", part).alias("components"))


NAMES = """, w AS (SELECT *, split_part(column_name, '_', 1) AS w1, split_part(column_name, '_', 2) AS w2 FROM cat_part),
n AS (SELECT w.*, concat(CASE WHEN w1 = 'RED' THEN split_part(column_description, ' ', 1) ELSE a.korean END, CASE WHEN w2 = 'RED' THEN split_part(column_description, ' ', 2) ELSE b.korean END) AS name,
  a.korean AS k1, b.korean AS k2, w1 = 'RED' OR w2 = 'RED' AS red FROM w JOIN korean a ON a.word = w1 JOIN korean b ON b.word = w2) """

_query(
    "b08_processing_key", "cat_part",
    lambda df: N.processing_key(df).select("source_id", "processing_key.name", "processing_key.description", "processing_key.context.table_name"),
    r"SELECT source_id, column_name AS name, trim(regexp_replace(column_description, '\s+', ' ', 'g')) AS description, lower(table_name) AS table_name FROM cat_part",
)
_query(
    "b08_context", "cat_doc",
    lambda df: N.processing_key(df.withColumn("table_name", F.upper("table_name"))).select("source_id", "processing_key.context.schema_name", "processing_key.context.table_name", "processing_key.context.data_type"),
    "SELECT source_id, lower(schema_name) AS schema_name, lower(table_name) AS table_name, '' AS data_type FROM cat_doc",
)
_query(
    "b22_semantic_units", "cat_part",
    lambda df: df.select("source_id", F.array_join(N.semantic_units(desc(), ["small", "ring"]), "|").alias("units")),
    r"SELECT source_id, replace(trim(regexp_replace(column_description, '(small|ring)', '|\1|', 'g'), '|'), '||', '|') AS units FROM cat_part",
)
_query(
    "b23_deterministic_name", "cat_part korean",
    lambda df, k: N.deterministic_names(df, glossary(k)).select("source_id", "name", "action", "confidence", F.array_join("unknown", ",").alias("unknown"), F.array_join("review_reasons", ",").alias("reasons")),
    NAMES + "SELECT source_id, name, '재작성' AS action, CASE WHEN red THEN 55 ELSE 96 END AS confidence, CASE WHEN w1 = 'RED' THEN split_part(column_description, ' ', 1) WHEN w2 = 'RED' THEN split_part(column_description, ' ', 2) ELSE '' END AS unknown, CASE WHEN red THEN 'unknown_english' ELSE '' END AS reasons FROM n",
)
_query(
    "c02_needs_review", "cat_part cand_part dict_rows korean",
    lambda s, c, d, k: N.needs_review(N.deterministic_names(s, glossary(k)).withColumns({x: F.array().cast("array<string>") for x in ("added_concepts", "removed_concepts")}), D.mapping_issues(s, c, d)),
    ISSUES + "SELECT source_id FROM issues WHERE severity = 'error' UNION SELECT source_id FROM cat_part WHERE list_contains(string_split(column_name, '_'), 'RED')",
)
_query("c03_pending_ids", "cat_part cand_part dict_rows", lambda s, c, d: N.pending_ids(D.mapping_issues(s, c, d)), ISSUES + "SELECT DISTINCT source_id FROM issues WHERE severity = 'error'")
_query(
    "c05_accept_resolution", "cat_part korean dict_part",
    lambda c, k, d: N.accept_resolution(c, proposals(c, k), d).select("source_id", "english_full_name", "korean_attribute_name", "confidence", "review_stratum"),
    NAMES + "SELECT source_id, CASE WHEN row_no % 7 = 0 THEN concat(w1, 'S ', w2, 'S') ELSE concat(w1, ' ', w2) END AS english_full_name, concat(k1, k2) AS korean_attribute_name, CASE WHEN row_no % 7 = 0 THEN 76 ELSE 82 END AS confidence, CASE WHEN row_no % 7 = 0 THEN 'unmapped_inference' ELSE 'mapping_ambiguity' END AS review_stratum FROM n WHERE row_no % 11 <> 0",
)


def _accept(c: DataFrame, k: DataFrame) -> DataFrame:
    base = core.cut(N.deterministic_names(c, glossary(k)).join(c.select("source_id", "row_no"), "source_id"))
    new = base.filter(~every(3, 2)).withColumns({"name": F.when(every(3), F.col("name")).otherwise("신규"), "confidence": F.lit(99)})
    return N.accept(base, new, base.filter(F.size("unknown") > 0), new.filter(every(5))).select("source_id", "name", "confidence", "failure_code")


_query(
    "c06_c07_accept", "cat_part korean", _accept,
    NAMES + """, o AS (SELECT *, row_no % 3 <> 2 AS has, row_no % 3 <> 2 AND row_no % 5 <> 0 AND (red OR row_no % 3 = 0) AS ok FROM n)
SELECT source_id, CASE WHEN ok AND row_no % 3 = 1 THEN '신규' ELSE name END AS name, CASE WHEN ok AND red THEN 85 WHEN ok THEN 99 WHEN red THEN 55 ELSE 96 END AS confidence,
  CASE WHEN ok THEN '' WHEN has THEN 'rejected_result' ELSE 'missing_result' END AS failure_code FROM o""",
)


def _batches(df: DataFrame) -> DataFrame:
    asked = df.select((F.col("row_no") % 97).alias("batch"), "row_no", "source_id", desc().alias("description"))
    got = asked.filter(~every(13)).withColumns({"source_id": F.when(every(17), F.concat(F.lit("x-"), "source_id")).otherwise(F.col("source_id")), "description": F.when(every(19), F.concat("description", F.lit("!"))).otherwise(F.col("description"))})
    return N.batch_response_check(asked.drop("row_no"), got.drop("row_no"))


_query("c08_batch_check", "cat_part", _batches, """, r AS (SELECT row_no % 97 AS batch, row_no % 13 = 0 AS m, row_no % 17 = 0 AS x, row_no % 19 = 0 AS d FROM cat_part)
SELECT batch, 0::BIGINT AS duplicates, count_if(m OR x) AS missing, count_if(NOT m AND x) AS unknown, count_if(NOT m AND NOT x AND d) AS changed FROM r GROUP BY batch HAVING count_if(m OR x OR d) > 0""")
_query("d09_token_overlap", "cat_part", lambda df: df.select("source_id", audit.token_overlap(desc(), F.concat_ws(" ", "table_name", F.lit("small"))).alias("out")), "SELECT source_id, list_has_any(string_split_regex(upper(column_description), '[^A-Z0-9]+'), string_split_regex(concat(upper(table_name), ' SMALL'), '[^A-Z0-9]+')) AS out FROM cat_part")


def _changed(df: DataFrame) -> DataFrame:
    return df.withColumns({"table_name": F.when(every(17), "changed").otherwise(F.col("table_name")), "data_type": F.when(every(5), "none").otherwise(F.col("data_type"))})


_query("d10_positional_join", "cat_part", lambda df: audit.positional_join(df, _changed(df), ["table_name", "data_type"]), "SELECT row_no, row_no % 17 <> 0 AS table_name, row_no % 5 <> 0 AS data_type FROM cat_part")
_query("h23_preservation", "cat_part", lambda df: audit.preservation(df, _changed(df), ["table_name", "data_type"]), "SELECT count(*) AS n_rows, count_if(row_no % 17 = 0 OR row_no % 5 = 0) AS changed_rows, count_if(row_no % 17 = 0) + count_if(row_no % 5 = 0) AS changed_cells FROM cat_part")
def _decided(df: DataFrame) -> DataFrame:
    return df.select("source_id", F.col("table_name").alias("group_id"), F.col("data_type").alias("selected_term"), F.create_map(F.lit("a"), F.col("row_no") % 2).alias("frequencies"), every(2).alias("tied"), F.lit("frequency").alias("selection_source"))


_query(
    "e09_decision_rollup", "cat_part",
    lambda df: N.decision_rollup(_decided(df)),
    """SELECT sha256(concat_ws(chr(0), table_name, data_type, concat('[{"key":"a","value":', row_no % 2, '}]'), CASE WHEN row_no % 2 = 0 THEN 'true' ELSE 'false' END, 'frequency')) AS decision_hash, table_name AS group_id, data_type AS selected_term, concat('[{"key":"a","value":', row_no % 2, '}]') AS frequencies, row_no % 2 = 0 AS tied, 'frequency' AS selection_source, count(DISTINCT source_id) AS n_sources, min(source_id) AS first_id, max(source_id) AS last_id FROM cat_part GROUP BY ALL""",
)
_query(
    "e09_decision_members", "cat_part", lambda df: N.decision_members(_decided(df).unionByName(_decided(df.filter(every(3))))),
    """SELECT DISTINCT sha256(concat_ws(chr(0), table_name, data_type, concat('[{"key":"a","value":', row_no % 2, '}]'), CASE WHEN row_no % 2 = 0 THEN 'true' ELSE 'false' END, 'frequency')) AS decision_hash, source_id FROM cat_part""",
)


def _events(df: DataFrame, aliases: DataFrame) -> DataFrame:
    reps = df.join(aliases.select(F.col("representative").alias("source_id")).distinct(), "source_id", "left_semi").filter(every(3))
    return reps.select("source_id", F.lit("review").alias("stage"), F.lit(1).alias("round"), F.when(every(2), "timeout").otherwise("rejected_result").alias("code"))


FIRSTS = ", f AS (SELECT source_id, min(row_no) OVER (PARTITION BY column_name, column_description) AS first FROM cat_part) "
_query("e16_recovery_events", "cat_part", lambda df: N.recovery_events(_events(df, core.dedup_sources(df, "mapping")), core.dedup_sources(df, "mapping")), FIRSTS + "SELECT source_id, 'review' AS stage, 1 AS round, CASE WHEN first % 2 = 0 THEN 'timeout' ELSE 'rejected_result' END AS code FROM f WHERE first % 3 = 0")
_query(
    "e15_recovery_stats", "cat_part",
    lambda df: N.recovery_stats(_events(df, core.dedup_sources(df, "mapping")), core.dedup_sources(df, "mapping").select(F.col("representative").alias("source_id"), "weight").distinct()),
    FIRSTS + "SELECT 'review' AS stage, CASE WHEN first % 2 = 0 THEN 'timeout' ELSE 'rejected_result' END AS code, count(*) AS failures, count(*) AS sources, count(*) AS open_sources, count(DISTINCT first) AS open_rows, first % 2 <> 0 AS rejection FROM f WHERE first % 3 = 0 GROUP BY ALL",
)


def _history(df: DataFrame) -> DataFrame:
    """Three rounds: every 3rd row fails in the first; of these every 2nd in the second, too, and every 5th fails otherwise;
    the third mends every 4th."""
    one = df.filter(every(3)).select("row_no", "source_id", F.lit("review").alias("stage"), F.lit(1).alias("round"), F.lit("timeout").alias("code"))
    two = one.withColumns({"round": F.lit(2), "code": F.when(every(5), "rejected_result").when(every(2), "timeout").otherwise("")})
    three = two.filter(every(4)).withColumns({"round": F.lit(3), "code": F.lit("")})
    return one.unionByName(two).unionByName(three).drop("row_no")


_query(
    "e15_open_failures", "cat_part", lambda df: N.recovery_stats(_history(df), df.select("source_id", (F.col("row_no") % 7 + 1).alias("weight"))),
    """, r AS (SELECT row_no % 7 + 1 AS w, row_no % 4 = 0 AS mended, CASE WHEN row_no % 5 = 0 THEN 'rejected_result' WHEN row_no % 2 = 0 THEN 'timeout' ELSE '' END AS second FROM cat_part WHERE row_no % 3 = 0),
e AS (SELECT 'timeout' AS code, w, false AS open FROM r UNION ALL SELECT second, w, NOT mended FROM r WHERE second <> '')
SELECT 'review' AS stage, code, CAST(sum(w) AS BIGINT) AS failures, CAST((SELECT sum(w) FROM r WHERE code = 'timeout' OR second = code) AS BIGINT) AS sources, CAST(coalesce(sum(w) FILTER (WHERE open), 0) AS BIGINT) AS open_sources, count_if(open) AS open_rows, code = 'rejected_result' AS rejection FROM e GROUP BY code""",
)
_query(
    "e20_reference_accuracy", "cat_part",
    lambda df: audit.reference_accuracy(df.select("column_name", F.col("table_name").alias("name")), df.groupBy("column_name").agg(F.min("table_name").alias("reference"))),
    "SELECT count(*) AS compared, count_if(table_name = r) AS exact, round(avg(CASE WHEN table_name = r THEN 1.0 ELSE 0 END), 6) AS rate FROM (SELECT table_name, min(table_name) OVER (PARTITION BY column_name) AS r FROM cat_part)",
)
_query(
    "f08_review_strata", "cat_part",
    lambda df: N.review_strata(df.withColumns({"action": F.when(every(2), "재작성").otherwise("유지"), "status": F.lit("자동확정"), "confidence": F.when(every(3), 80).otherwise(95), "terms": every(5)})).withColumn("review_strata", F.array_join("review_strata", ",")),
    """, k AS (SELECT column_name, column_description, min(row_no) AS f, min_by(source_id, row_no) AS source_id, count(*) AS n FROM cat_part GROUP BY ALL), m AS (SELECT *, count(*) OVER (PARTITION BY column_name) > 1 AS many FROM k)
SELECT source_id, n AS occurrence_count, array_to_string(list_filter([CASE WHEN n > 1 OR many THEN 'duplicate_context' END, 'english_translation', CASE WHEN f % 2 = 0 THEN 'llm_rewrite' END, CASE WHEN f % 3 = 0 THEN 'review_needed' END, CASE WHEN f % 5 = 0 THEN 'terminology_frequency' END], lambda x: x IS NOT NULL), ',') AS review_strata FROM m""",
)


def _locked(df: DataFrame) -> DataFrame:
    """Digest of a locked sample of every second row, in order."""
    manifest = df.filter(every(2)).select(F.col("row_no").alias("pos"), "source_id")
    rows = N.locked_sample(df, manifest, core.cut(N.lock_manifest(manifest, "S7")), "S7")
    return digests.sequence_digest(rows, "pos", "source_id", "column_name")


_query(
    "f11_locked_digest", "cat_part", _locked,
    """, r AS (SELECT row_no, concat(row_no, ':', source_id, chr(0), column_name) AS t FROM cat_part WHERE row_no % 2 = 0), b AS (SELECT row_no // 1000 AS i, sha256(string_agg(t, chr(10) ORDER BY row_no)) AS t FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n, CASE WHEN (SELECT max(row_no) FROM r) < 1000 THEN (SELECT sha256(string_agg(t, chr(10) ORDER BY row_no)) FROM r) ELSE (SELECT sha256(string_agg(t, chr(10) ORDER BY i)) FROM b) END AS sha256""",
)
_query("f11_locked_sample", "cat_part", lambda df: N.locked_sample(df, df.filter(every(50)).select(F.col("row_no").alias("pos"), "source_id")).select("pos", "source_id", "column_name"), "SELECT row_no AS pos, source_id, column_name FROM cat_part WHERE row_no % 50 = 0")
_query("h07_order", "cat_part", lambda df: audit.order_issues(df, df.filter(~every(11)).withColumn("row_no", F.col("row_no") + F.col("row_no") % 2)).select("code"), "SELECT unnest(['row_count_mismatch', 'row_order_changed']) AS code FROM (SELECT count(*) AS n FROM cat_part)")
_query(
    "h09_component_issues", "cat_part korean dict_part",
    lambda c, k, d: audit.component_issues(c, proposals(c, k).withColumn("evidence", X.evidence_text(F.col("components"))), d).select("source_id", "code"),
    "SELECT source_id, 'component_coverage_mismatch' AS code FROM cat_part WHERE row_no % 11 = 0 UNION ALL SELECT source_id, 'mapping_evidence_mismatch' FROM cat_part WHERE row_no % 7 = 0 UNION ALL SELECT source_id, 'mapping_evidence_mismatch' FROM cat_part WHERE row_no % 7 = 0 AND row_no % 11 <> 0",
)
_query(
    "h11_context_issues", "cat_part",
    lambda df: audit.context_issues(df, df.select("source_id", (F.col("row_no") % 2).cast("string").alias("english_full_name"), F.lit("").alias("korean_attribute_name"))).select("code", "details"),
    "SELECT 'inconsistent_context_result' AS code, concat(column_name, ' / ', table_name, ' / ', table_description, ' / ', data_type) AS details FROM cat_part GROUP BY column_name, table_name, table_description, data_type HAVING count(DISTINCT row_no % 2) > 1",
)
_query(
    "h12_set_issues", "cat_part cand_part",
    lambda s, c: audit.set_issues(s, c).select("source_id", "code"),
    "SELECT source_id, 'duplicate_result' AS code FROM cand_part GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT source_id, 'unknown_source_id' FROM cand_part WHERE source_id NOT IN (SELECT source_id FROM cat_part) UNION ALL SELECT source_id, 'missing_result' FROM cat_part WHERE source_id NOT IN (SELECT source_id FROM cand_part)",
)
_query("h18_duplicate_inconsistent", "cat_part", lambda df: audit.duplicate_inconsistent(df.select("source_id", F.col("column_name").alias("key"), F.col("table_name").alias("name"))).select("source_id", "code"), "SELECT source_id, 'duplicate_input_inconsistent' AS code FROM cat_part WHERE column_name IN (SELECT column_name FROM cat_part GROUP BY 1 HAVING count(DISTINCT table_name) > 1)")
_query(
    "h19_terminology_issues", "cat_part",
    lambda df: audit.terminology_issues(df.select("source_id", F.split(desc(), " ").alias("units")), df.select(F.when(every(13), F.concat(F.lit("x-"), "source_id")).otherwise(F.col("source_id")).alias("source_id"), F.array(F.lit("small"), F.lit("large")).alias("candidates"), F.lit("small").alias("selected_term"))).select("source_id", "code"),
    "SELECT concat('x-', source_id) AS source_id, 'terminology_unknown_source' AS code FROM cat_part WHERE row_no % 13 = 0 UNION ALL SELECT source_id, 'terminology_decision_mismatch' FROM cat_part WHERE row_no % 13 <> 0 AND list_contains(string_split(column_description, ' '), 'large')",
)
_query(
    "h20_status_issues", "cat_part",
    lambda df: audit.status_issues(df.select("source_id", F.when(every(6), "자동확정").otherwise("검토필요").alias("status"), F.when(every(4), "x").otherwise("").alias("codes")), df.select("source_id", F.lit("검토필요").alias("status"), F.lit("").alias("codes"))).select("source_id", "code"),
    "SELECT source_id, 'status_mismatch' AS code FROM cat_part WHERE row_no % 6 = 0 UNION ALL SELECT source_id, 'validation_issue_codes_mismatch' FROM cat_part WHERE row_no % 4 = 0",
)
_query(
    "h24_result_audit", "cat_part",
    lambda df: audit.result_audit(df.select(F.when(every(5), "").otherwise(F.col("column_name")).alias("english_full_name"), F.when(every(7), "미정").when(every(4), "").otherwise(desc()).alias("korean_attribute_name"), F.when(every(2), "").otherwise("x").alias("evidence"), (F.col("row_no") % 120).alias("confidence"), F.when(every(3), "검증실패").otherwise("검토필요").alias("status"))),
    "SELECT count(*) AS n_rows, count_if(row_no % 5 = 0) AS blank_full_name, count_if(row_no % 4 = 0 AND row_no % 7 <> 0) AS blank_korean_name, count_if(row_no % 4 <> 0 AND row_no % 7 <> 0) AS invalid_korean_name, count_if(row_no % 7 = 0) AS placeholder_name, count_if(row_no % 2 = 0) AS blank_evidence, count_if(row_no % 120 > 100) AS confidence_out_of_range, 0::BIGINT AS confirmed, count_if(row_no % 3 <> 0) AS to_review, count_if(row_no % 3 = 0) AS failed FROM cat_part",
)
_query("i07_resolution_requests", "cat_glued dict_part", lambda c, d: N.resolution_requests(D.segment_names(c, d), d).select("column_name", "table_name", F.array_join("candidates", " ").alias("candidates"), F.size("options").alias("n_options")))
_query(
    "i12_finalize", "cat_part korean",
    lambda c, k: N.finalize(N.deterministic_names(c, glossary(k)), core.issue(c.filter(every(9)), "bad"), c.filter(every(4)).select("source_id", F.lit(True).alias("tied"))),
    NAMES + "SELECT source_id, CASE WHEN red THEN 55 WHEN row_no % 4 = 0 THEN 89 ELSE 96 END AS confidence, CASE WHEN row_no % 9 = 0 THEN '검증실패' WHEN red OR row_no % 4 = 0 THEN '검토필요' ELSE '자동확정' END AS status, CASE WHEN row_no % 9 = 0 THEN 'bad' ELSE '' END AS codes FROM n",
)
_query(
    "i13_mark_failures", "cat_part korean",
    lambda c, k: N.mark_failures(N.deterministic_names(c, glossary(k)), c.filter(every(4)).select("source_id", F.lit("timeout").alias("code"))).select("source_id", "confidence", F.array_join("review_reasons", ",").alias("reasons")),
    NAMES + "SELECT source_id, CASE WHEN red THEN 55 WHEN row_no % 4 = 0 THEN 85 ELSE 96 END AS confidence, concat_ws(',', CASE WHEN red THEN 'unknown_english' END, CASE WHEN row_no % 4 = 0 THEN 'review:timeout' END) AS reasons FROM n",
)
OLD = {"english_full_name": "OLD", "korean_attribute_name": "이름", "evidence": ""}
_query(
    "i15_repair_failed", "cat_part korean dict_part",
    lambda c, k, d: N.repair_failed(c.withColumns({**{a: F.lit(b) for a, b in OLD.items()}, "confidence": F.lit(50), "status": F.when(every(4), "검증실패").otherwise("자동확정")}), c, proposals(c, k), d).select("source_id", "korean_attribute_name", "status", "confidence"),
    NAMES + ", o AS (SELECT *, row_no % 4 = 0 AND row_no % 11 <> 0 AS ok FROM n) SELECT source_id, CASE WHEN ok THEN concat(k1, k2) ELSE '이름' END AS korean_attribute_name, CASE WHEN ok THEN '검토필요' WHEN row_no % 4 = 0 THEN '검증실패' ELSE '자동확정' END AS status, CASE WHEN ok AND row_no % 7 = 0 THEN 76 WHEN ok THEN 82 ELSE 50 END AS confidence FROM o",
)
_query(
    "i16_apply_corrections", "cat_part",
    lambda c: N.apply_corrections(c.withColumns({**{a: F.lit(b) for a, b in OLD.items()}, "confidence": F.lit(50), "status": F.lit("검증실패")}), c.filter(every(10)).select("source_id", F.lit(" new").alias("english_full_name"), F.when(every(30), "bad").otherwise("보 정").alias("korean_attribute_name"), F.lit(None).cast("int").alias("confidence")))[0].select("source_id", "english_full_name", "korean_attribute_name", "confidence", "status"),
    ", o AS (SELECT source_id, row_no % 10 = 0 AND row_no % 30 <> 0 AS ok FROM cat_part) SELECT source_id, CASE WHEN ok THEN 'NEW' ELSE 'OLD' END AS english_full_name, CASE WHEN ok THEN '보정' ELSE '이름' END AS korean_attribute_name, CASE WHEN ok THEN 88 ELSE 50 END AS confidence, CASE WHEN ok THEN '검토필요' ELSE '검증실패' END AS status FROM o",
)
_query(
    "a08_read_results", "cat_part korean",
    lambda c, k: N.read_results(c.join(proposals(c, k).select("source_id", X.evidence_text(F.col("components")).alias("e")), "source_id").select("source_id", "column_name", F.lit("").alias("english_full_name"), F.lit("").alias("korean_attribute_name"), F.lit("자동확정").alias("status"), F.when(~every(5), F.col("e")).alias("evidence"))).select("source_id", F.size("components").alias("n"), "review_stratum"),
    "SELECT source_id, CASE WHEN row_no % 5 = 0 OR row_no % 11 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN row_no % 5 = 0 THEN 'unmapped_inference' ELSE 'deterministic' END AS review_stratum FROM cat_part",
)
_query(
    "j02_score_observations", "ratings korean",
    lambda r, k: audit.score_observations(
        r.groupBy("review").agg(F.avg("clarity").alias("clarity"), F.avg("tone").alias("tone")).unpivot(["review"], ["clarity", "tone"], "dimension", "rating"),
        k.sparkSession.createDataFrame([("clarity", 60.0), ("tone", 40.0)], "id string, weight double"),
        r.groupBy("review").agg(F.count_if(F.col("severity") == "major").alias("critical"), F.lit(0).alias("failed_checks"), F.count("*").alias("reviewed"), F.count("comment").alias("expected")),
    ),
    """, s AS (SELECT review, 60 * avg(clarity) / 5 + 40 * avg(tone) / 5 AS raw, least(avg(clarity), avg(tone)) AS lowest, count_if(severity = 'major') AS critical FROM ratings GROUP BY 1),
c AS (SELECT *, round(CASE WHEN critical > 0 THEN least(raw, 69) ELSE raw END, 2) AS score FROM s) SELECT review, round(raw, 2) AS raw, score, score >= 90 AND lowest >= 3.5 AND critical = 0 AS passed FROM c""",
)
_query(
    "i18_name_from_comments", "cat_part korean",
    lambda c, k: N.name_from_comments(c, glossary(k)).select("source_id", "name", "confidence", "status", "codes"),
    NAMES + "SELECT source_id, name, CASE WHEN red THEN 55 ELSE 96 END AS confidence, CASE WHEN red THEN '검증실패' ELSE '자동확정' END AS status, CASE WHEN red THEN 'english_not_allowed' ELSE '' END AS codes FROM n",
)


def _integrity(s: DataFrame, c: DataFrame, k: DataFrame) -> DataFrame:
    names = N.deterministic_names(s, glossary(k))
    return audit.integrity_checks(
        {
            "row_preservation": core.id_difference(s, names),
            "required_columns": s.filter("column_name is null or column_description is null"),
            "character_policy": names.filter(~X.is_valid_name(F.col("name"), "comment")),
            "numeric": names.filter(~X.digits_preserved(F.col("original_description"), F.col("name"))),
            "evidence_traceable": core.missing(c, s).select("source_id").distinct(),
            "duplicate_consistency": core.consistency(names.join(s.select("source_id", "column_name"), "source_id"), ["column_name"], F.col("name")),
        }
    )


_query("h21_integrity", "cat_part cand_part korean", _integrity, """, c AS (SELECT 'row_preservation' AS name, 0::BIGINT AS failures UNION ALL SELECT 'required_columns', 0 UNION ALL SELECT 'numeric', 0 UNION ALL SELECT 'duplicate_consistency', 0
UNION ALL SELECT 'character_policy', count_if(list_contains(string_split(column_name, '_'), 'RED')) FROM cat_part
UNION ALL SELECT 'evidence_traceable', count(DISTINCT source_id) FROM cand_part WHERE source_id NOT IN (SELECT source_id FROM cat_part)) SELECT name, failures = 0 AS passed, failures FROM c""")
