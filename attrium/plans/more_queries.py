"""Queries of sources, proposals, review and further audits; adds them to those of naming_queries."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import audit, core, dictionary as D, digests, naming as N, proposals as P, review, terms
from ..sources import catalog
from . import naming_queries as NQ
from .naming_queries import every, proposals
from .queries import FIVE, ORACLES, QUERIES, QUOTAS, SYN, _column, _query, _synonyms, _units, desc

__all__ = ["ORACLES", "QUERIES"]

_query("a01_normalize_headers", "cat_part", lambda df: catalog.normalize_headers(df.select(F.col("source_id").alias(" source id (*) "), F.col("column_name").alias("column\tname"), F.col("data_type"))), "SELECT source_id AS sourceid, column_name AS columnname, data_type FROM cat_part")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part.parquet as a catalog."""
    good, _ = catalog.read_catalog(spark, f"{sf_dir}/part.parquet", "parquet", ["p_name", "p_type"], "p_name", "p_partkey")
    return good.select("row_no", "source_id", F.col("p_name").alias("column_name"), F.col("p_type").alias("table_name"))


QUERIES["a02_read_catalog"] = _catalog
ORACLES["a02_read_catalog"] = "SELECT p_partkey AS row_no, concat('row-', p_partkey) AS source_id, upper(trim(p_name)) AS column_name, p_type AS table_name FROM part"
_query("a02_number_rows", "cat_doc", lambda df: catalog.number_rows(df.select("source_id"), "n").agg(F.count("*").alias("n_rows"), F.min("n").alias("first"), F.max("n").alias("last"), F.count_distinct("n").alias("numbers")), "SELECT count(*) AS n_rows, 1::BIGINT AS first, count(*) AS last, count(*) AS numbers FROM cat_doc")
_query("a03_reject_incomplete", "cat_part", lambda df: catalog.reject_incomplete_rows(df.withColumn("column_name", F.when(every(5), " ").otherwise(F.when(~every(7), F.col("column_name")))))[1].select("source_id"), "SELECT source_id FROM cat_part WHERE row_no % 5 = 0 OR row_no % 7 = 0")
_query("a04_resolve_aliases", "cat_part", lambda df: catalog.resolve_aliases(df, {"id": ["nothing", "source_id"], "name": ["column_name", "table_name"], "absent": ["nowhere"]}), "SELECT source_id AS id, column_name AS name, CAST(NULL AS VARCHAR) AS absent FROM cat_part")
_query(
    "a07_check_rules", "part_words",
    lambda w: terms.check_rules(
        w.select("word").distinct().select(F.explode(F.when(F.col("word") < "C", F.array("word", "word")).otherwise(F.array("word"))).alias("source"), F.when(F.col("word") != "RED", "x").otherwise(" ").alias("target")),
        w.select(F.substring("word", 1, 1).alias("group_id"), F.col("word").alias("candidate")).distinct().unionByName(w.filter("word = 'GEAR'").select(F.lit("X").alias("group_id"), F.col("word").alias("candidate")).limit(1)),
    ),
    """, w AS (SELECT DISTINCT word FROM part_words), g AS (SELECT substr(word, 1, 1) AS group_id, word FROM w UNION ALL SELECT 'X', word FROM w WHERE word = 'GEAR')
SELECT 'duplicate_source' AS code, word AS name FROM w WHERE word < 'C' UNION ALL SELECT 'empty_target', word FROM w WHERE word = 'RED'
UNION ALL SELECT 'few_candidates', group_id FROM g GROUP BY group_id HAVING count(DISTINCT word) < 2 UNION ALL SELECT 'candidate_in_two_groups', word FROM g GROUP BY word HAVING count(DISTINCT group_id) > 1""",
)
_query(
    "a12_review_sheet", "cat_part",
    lambda df: catalog.review_sheet(df.select("source_id", F.when(every(3), "검증실패").when(every(2), "검토필요").otherwise("자동확정").alias("status"), (F.col("row_no") % 100).alias("confidence"), F.when(every(5), "mapping_ambiguity").otherwise("deterministic").alias("review_stratum"), F.col("table_name").alias("reason"))),
    "SELECT source_id, CASE WHEN row_no % 3 = 0 THEN '검증실패' ELSE '검토필요' END AS status, concat_ws(' | ', CASE WHEN row_no % 3 = 0 THEN 'fix errors' END, CASE WHEN row_no % 100 < 85 THEN 'low confidence' END, CASE WHEN row_no % 5 = 0 THEN 'mapping_ambiguity' END) AS recommended_check, table_name AS reason FROM cat_part WHERE row_no % 3 = 0 OR row_no % 2 = 0",
)
_query("a15_blind_sample", "ratings", lambda df: catalog.blind_sample(df.select("source_id", "stratum", F.lit(5).alias("confidence"), F.lit("x").alias("status")), ["clarity"]), "SELECT source_id, stratum, '' AS clarity, '' AS severity, '' AS comment FROM ratings")

ANSWER = "concat('<think>[1]</think>```json {\"resolutions\":[{\"id\":\"', source_id, '\",', CASE WHEN row_no % 7 = 0 THEN '\"r\":\"none\"' WHEN row_no % 5 = 0 THEN concat('\"components\":[{\"source_fragment\":\"', column_name, '\",\"full_name\":\"N\",\"korean_word\":\"이름\",\"origin\":\"inference\"}],\"reason\":\"long\"') ELSE concat('\"c\":[[\"A\",\"B\",\"가\",\"mapping\"],[\"', data_type, '\",\"', data_type, '\",\"나\",\"numeric\"]],\"r\":\"short\"') END, '}]}``` tail')"
_query(
    "b27_decode_resolutions", "cat_part",
    lambda df: P.decode_resolutions(df.select(F.col("row_no").alias("batch"), F.expr(ANSWER).alias("answer")))[0].select("source_id", F.size("components").alias("n"), F.col("components")[0]["fragment"].alias("first"), "full_name", "korean_attribute_name", "reason"),
    """SELECT source_id, CASE WHEN row_no % 5 = 0 THEN 1 ELSE 2 END AS n, CASE WHEN row_no % 5 = 0 THEN column_name ELSE 'A' END AS first, CASE WHEN row_no % 5 = 0 THEN 'N' ELSE concat('B ', data_type) END AS full_name,
  CASE WHEN row_no % 5 = 0 THEN '이름' ELSE '가나' END AS korean_attribute_name, CASE WHEN row_no % 5 = 0 THEN 'long' ELSE 'short' END AS reason FROM cat_part WHERE row_no % 7 <> 0""",
)
_query("b26_unread_answers", "cat_part", lambda df: P.decode_resolutions(df.select(F.col("row_no").alias("batch"), F.expr(ANSWER).alias("answer")))[1], "SELECT row_no AS batch, 'response_error' AS failure_code FROM cat_part WHERE row_no % 7 = 0")
_query("b28_encode_requests", "cat_part dict_part", lambda c, d: P.encode_requests(c, D.segment_names(c, d), d))
_column("b30_contains_distinct", "cat_doc", lambda: X.contains_distinct(desc(), F.lit("the"), F.array(F.lit("the"), F.lit("then"), F.lit("there"))), "contains(column_description, 'the') AND NOT contains(column_description, 'then') AND NOT contains(column_description, 'there')")
_column("b33_stable_unique", "cat_part", lambda: F.array_join(X.stable_unique(X.clean_list(F.split(F.concat(desc(), F.lit(" z "), desc()), " "))), " "), "CASE WHEN split_part(column_description, ' ', 1) = split_part(column_description, ' ', 2) THEN concat(split_part(column_description, ' ', 1), ' z') ELSE concat(column_description, ' z') END")

_query("d04_canonical_lookup", "cand_part dict_rows", lambda c, d: D.canonical_lookup(c, d).select("source_id", "abbreviation", "korean_word", "canonical"), """, known AS (SELECT abbreviation, korean_word, min_by(full_name, (-occurrence_count, row_no)) AS canonical FROM dict_rows GROUP BY ALL)
SELECT source_id, abbreviation, korean_word, canonical FROM cand_part LEFT JOIN known USING (abbreviation, korean_word)""")
_query("d08_description_evidence", "cand_said cat_said", lambda c, s: audit.description_evidence(c, s).select("source_id", "abbreviation", "korean_word"), "SELECT source_id, abbreviation, korean_word FROM cand_said JOIN cat_said USING (source_id) WHERE contains(replace(column_description, ' ', ''), korean_word)")
_query("d11_reference_match", "cat_part", audit.references, "SELECT column_name, min(column_description) AS reference, count(*) AS n FROM cat_part GROUP BY column_name HAVING count(DISTINCT column_description) = 1")
_query("e10_result_stats", "cat_part", lambda df: core.result_stats(df, ["table_name", "data_type"]), "SELECT table_name, data_type, count(*) AS n, grouping(table_name, data_type) AS level FROM cat_part GROUP BY CUBE (table_name, data_type)")


def _sample(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    population = df.select("source_id", F.array("stratum").alias("review_strata"))
    return population, review.stratified_sample(population, "S7", QUOTAS, 60)


SAMPLE = ORACLES["f09_stratified_sample"].replace("SELECT * FROM a UNION ALL", ", sample AS (SELECT * FROM a UNION ALL", 1) + ")"
_query("f10_sample_manifest", "ratings", lambda df: (lambda p: review.sample_manifest(*p, QUOTAS))(_sample(df)))
ORACLES["f10_sample_manifest"] = SAMPLE + f""", q AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in QUOTAS.items())}) t(stratum, required))
SELECT q.stratum, q.required, (SELECT count(*) FROM ratings r WHERE r.stratum = q.stratum) AS available, (SELECT count(*) FROM sample s WHERE s.stratum = q.stratum) AS selected, NOT EXISTS (SELECT 1 FROM ratings r WHERE r.stratum = q.stratum) AS missing,
  (SELECT count(*) FROM ratings) AS population, (SELECT sha256(string_agg(sha256(source_id), chr(10) ORDER BY sha256(source_id))) FROM ratings) AS population_sha256, (SELECT count(*) FROM sample) AS sample, (SELECT sha256(string_agg(source_id, chr(10) ORDER BY source_id)) FROM sample) AS selection_sha256 FROM q"""
_query("f14_sort_output", "cat_part", lambda df: core.sort_output(df.select("source_id", "column_name")), "SELECT source_id, column_name FROM cat_part")
_query("g04_required_minus_present", "korean part_words", lambda k, w: core.required_minus_present(k, w.filter("row_no % 10 < 2"), "word"), "SELECT word FROM korean WHERE word NOT IN (SELECT word FROM part_words WHERE row_no % 10 < 2)")


def _audit(df: DataFrame) -> DataFrame:
    """Decisions from units, but for g3, against counts in the texts; no name holds `none`."""
    frequency = terms.synonym_frequency(_units(df), _synonyms(df))
    decided = terms.select_preferred_term(frequency).join(terms.term_groups(frequency).select("group_id", "frequencies"), "group_id").filter("group_id <> 'g3'")
    return audit.terminology_audit(df, df.select("source_id", F.when(F.col("row_no") < 0, desc()).otherwise("of").alias("name")), _synonyms(df), decided)


_query("h22_terminology_audit", "cat_doc", _audit, SYN + """, surface AS (SELECT 'g1' AS group_id, unnest(regexp_extract_all(column_description, 'that|the')) AS t FROM cat_doc UNION ALL SELECT 'g2', unnest(regexp_extract_all(column_description, 'with|of')) FROM cat_doc UNION ALL SELECT 'g3', unnest(regexp_extract_all(column_description, 'never|none')) FROM cat_doc),
counts AS (SELECT syn.group_id, candidate, count(t) AS n FROM syn LEFT JOIN surface ON surface.group_id = syn.group_id AND t = candidate GROUP BY ALL), most AS (SELECT group_id, max(n) AS top, max(n) = min(n) AS even FROM counts GROUP BY 1),
dec AS (SELECT * FROM pref WHERE group_id <> 'g3')
SELECT DISTINCT d.group_id, 'frequency_mismatch' AS code FROM dec d JOIN counts c USING (group_id) JOIN freq f ON f.group_id = c.group_id AND f.candidate = c.candidate WHERE c.n <> f.frequency
UNION ALL SELECT group_id, 'tie_mismatch' FROM dec JOIN most USING (group_id) WHERE tied <> even
UNION ALL SELECT d.group_id, 'selected_not_most_frequent' FROM dec d JOIN counts c ON c.group_id = d.group_id AND c.candidate = d.selected_term JOIN most m ON m.group_id = d.group_id WHERE c.n <> top
UNION ALL SELECT group_id, 'group_missing' FROM most WHERE top > 0 AND group_id = 'g3'
UNION ALL SELECT group_id, 'selected_term_absent' FROM dec WHERE selected_term <> 'of'""")

_query(
    "i19_name_from_dictionary", "cat_part dict_short korean",
    lambda c, d, k: P.name_from_dictionary(c, d, proposals(c, k)).select("source_id", "korean_attribute_name", "confidence", "review_stratum", "status", "validation_codes"),
    FIVE + """, taken AS (SELECT done.*, r1.korean AS p1, r2.korean AS p2, NOT (own = 'deterministic' AND confidence >= 85) AND row_no % 11 <> 0 AS ok, row_no % 7 = 0 OR w1 = 'RED' OR w2 = 'RED' AS inferred FROM done JOIN korean r1 ON r1.word = w1 JOIN korean r2 ON r2.word = w2),
merged AS (SELECT source_id, row_no, dup, CASE WHEN ok THEN CASE WHEN p1 = p2 THEN p1 ELSE concat(p1, p2) END ELSE korean END AS name, CASE WHEN NOT ok THEN confidence WHEN inferred THEN 76 ELSE 82 END AS c, CASE WHEN NOT ok THEN review_stratum WHEN inferred THEN 'unmapped_inference' ELSE 'mapping_ambiguity' END AS s FROM taken),
pick2 AS (SELECT source_id FROM merged WHERE NOT dup AND NOT (s = 'deterministic' AND c >= 85) ORDER BY s <> 'deterministic', row_no LIMIT 5),
last AS (SELECT source_id, name, c, CASE WHEN dup THEN 'duplicate_context' WHEN source_id IN (SELECT source_id FROM pick2) THEN 'review_needed' ELSE s END AS stratum FROM merged)
SELECT source_id, name AS korean_attribute_name, CAST(c AS INT) AS confidence, stratum AS review_stratum, CASE WHEN contains(name, '미정') THEN '검증실패' WHEN c >= 85 AND stratum = 'deterministic' THEN '자동확정' ELSE '검토필요' END AS status,
  concat_ws(',', CASE WHEN c < 85 THEN 'low_confidence' END, CASE WHEN contains(name, '미정') THEN 'placeholder_korean_name' END) AS validation_codes FROM last""",
)
_query(
    "j03_strata_coverage", "ratings", lambda r: review.strata_coverage(r.filter("stratum <> 'fr' or clarity > 1").select("review", "stratum"), QUOTAS),
    ", r AS (SELECT * FROM ratings WHERE stratum <> 'fr' OR clarity > 1), s AS (SELECT review, list_sort(list_filter(['de','en','es','fr'], lambda x: NOT list_contains(list(stratum), x))) AS gone FROM r GROUP BY review) SELECT review, round((4 - len(gone)) / 4.0, 6) AS coverage, array_to_string(gone, ',') AS missing_strata FROM s",
)
_query("j05_score_history", "ratings", lambda r: review.score_history(r.groupBy(F.col("stratum").alias("stage"), F.col("review").alias("run")).agg(F.round(F.avg("clarity") * 20, 6).alias("score")).withColumn("passed", F.col("score") >= 85)), """, s AS (SELECT stratum AS stage, review AS run, round(avg(clarity) * 20, 6) AS score FROM ratings GROUP BY ALL)
SELECT stage, run, score, score >= 85 AS passed, round(score - lag(score) OVER (PARTITION BY stage ORDER BY run), 6) AS change FROM s""")


def echo(requests: pd.DataFrame) -> Iterator[str]:
    """Stands for a model: every request's own id with one component."""
    for i, source_id in enumerate(requests["source_id"]):
        yield ('{"resolutions":[' if not i else ",") + json.dumps({"id": source_id, "c": [[source_id, "N", "이름", "inference"]], "r": "echo"})
    yield "]}"


_query("u01_propose", "cat_part", lambda df: P.decode_resolutions(P.propose(df.select("source_id", "row_no", F.col("column_name").alias("request")), echo))[0].select("source_id", "korean_attribute_name", "reason"), "SELECT source_id, '이름' AS korean_attribute_name, 'echo' AS reason FROM cat_part")


def forty_more(requests: pd.DataFrame) -> Iterator[str]:
    """Stands for a model: to a request that is a number, that number and forty."""
    found = [{"id": i, "c": [["A", "N", "이름", "inference"]], "r": str(int(n) + 40)} for i, n in zip(requests["source_id"], requests["request"], strict=True)]
    yield json.dumps({"resolutions": found})


def _raised(todo: DataFrame) -> DataFrame:
    given = P.decode_resolutions(P.propose(todo.withColumn("request", F.col("confidence").cast("string")), forty_more))[0]
    return todo.drop("confidence").join(given.select("source_id", F.col("reason").cast("long").alias("confidence")), "source_id")


_query(
    "i14_review_loop", "cat_part",
    lambda df: N.review_loop(df.select("source_id", "row_no", (F.col("row_no") % 100).alias("confidence")), lambda r: r.filter("confidence < 90"), _raised, 2).drop("row_no"),
    ", a AS (SELECT source_id, CASE WHEN row_no % 100 < 90 THEN row_no % 100 + 40 ELSE row_no % 100 END AS c FROM cat_part) SELECT source_id, CASE WHEN c < 90 THEN c + 40 ELSE c END AS confidence FROM a",
)


GROUPS = (("g1", "the", "that"), ("g2", "of", "with"), ("g3", "none", "never"))


def _affected(df: DataFrame) -> DataFrame:
    """Rows that hold a candidate of a group, but for every 11th, of which the others are listed; every 17th twice, every
    19th under another id."""
    each = df.select("source_id", "row_no", F.explode(F.array(*[F.struct(F.lit(g).alias("group_id"), (F.contains(desc(), F.lit(a)) | F.contains(desc(), F.lit(b))).alias("holds")) for g, a, b in GROUPS])).alias("g"))
    listed = each.filter(F.col("g.holds") != every(11)).select("g.group_id", F.when(every(19), F.concat(F.lit("x-"), "source_id")).otherwise(F.col("source_id")).alias("source_id"), "row_no")
    return listed.unionByName(listed.filter(every(17))).drop("row_no")


def _affected_audit(df: DataFrame) -> DataFrame:
    frequency = terms.synonym_frequency(_units(df), _synonyms(df))
    names = df.select("source_id", F.when(every(2), "of the never").otherwise("with that none").alias("name"))
    return audit.affected_issues(df, names, _synonyms(df), terms.select_preferred_term(frequency), _affected(df))


_query("h22_affected_ids", "cat_doc", _affected_audit, SYN + """, holds AS (SELECT source_id, row_no, g.group_id, contains(column_description, a) OR contains(column_description, b) AS holds FROM cat_doc, (VALUES ('g1','the','that'),('g2','of','with'),('g3','none','never')) g(group_id, a, b)),
once AS (SELECT group_id, CASE WHEN row_no % 19 = 0 THEN concat('x-', source_id) ELSE source_id END AS source_id, row_no, row_no % 17 = 0 AS twice FROM holds WHERE holds <> (row_no % 11 = 0))
SELECT group_id, source_id, 'affected_missing' AS code FROM holds WHERE holds AND NOT EXISTS (SELECT 1 FROM once o WHERE o.group_id = holds.group_id AND o.source_id = holds.source_id)
UNION ALL SELECT group_id, source_id, 'affected_extra' FROM once WHERE row_no % 11 = 0 OR row_no % 19 = 0
UNION ALL SELECT group_id, source_id, 'affected_twice' FROM once WHERE twice
UNION ALL SELECT group_id, source_id, 'affected_unknown' FROM once WHERE row_no % 19 = 0
UNION ALL SELECT o.group_id, o.source_id, 'selected_term_absent' FROM once o JOIN pref p USING (group_id) WHERE row_no % 19 <> 0 AND NOT contains(CASE WHEN row_no % 2 = 0 THEN 'of the never' ELSE 'with that none' END, p.selected_term)""")


def _integrity_audit(s: DataFrame, k: DataFrame) -> DataFrame:
    """Results with headers moved, changed and inserted, and something of everything wrong with their rows."""
    names = NQ.N.deterministic_names(s, NQ.glossary(k)).select("source_id", "name")
    rows = s.join(names, "source_id").withColumns(
        {
            "table_name": F.when(every(5), "changed").otherwise(F.col("table_name")),
            "name": F.concat("name", F.when(every(7), "!").otherwise(""), F.when(every(8), "7").otherwise("")),
            "action": F.when(every(3), "유지").otherwise("재작성"),
            "confidence": F.col("row_no") % 120,
            "status": F.when(every(6), "?").when(every(10), "검토필요").otherwise("자동확정"),
            "reason": F.when(every(4), " ").otherwise("why"),
            "review_reason": F.when(every(9), "x").otherwise(""),
        }
    )
    results = rows.select("row_no", "source_id", "table_name", "column_name", "table_description", F.lit(1).alias("extra"), F.col("data_type").alias("DATA_TYPE"), "column_description", *audit.RESULT)
    spark = s.sparkSession
    synonyms = spark.createDataFrame([("g1", "small"), ("g1", "large")], "group_id string, candidate string")
    decisions = spark.createDataFrame([("g1", "small", {"small": 0, "large": 0}, False)], "group_id string, selected_term string, frequencies map<string,long>, tied boolean")
    found = audit.integrity_audit(s, results, synonyms, decisions, s.limit(0).select(F.lit("g1").alias("group_id"), "source_id"))
    return found.groupBy("check", "code", "severity").agg(F.count("*").alias("n"), F.count("source_id").alias("n_rows"))


_query("h21_integrity_audit", "cat_part korean", _integrity_audit, NQ.NAMES + """, r AS (SELECT *, concat(name, CASE WHEN row_no % 7 = 0 THEN '!' ELSE '' END, CASE WHEN row_no % 8 = 0 THEN '7' ELSE '' END) AS said FROM n),
t AS (SELECT count(*) AS n, count_if(contains(column_description, 'small')) AS s, count_if(contains(column_description, 'large')) AS l, sum(len(regexp_extract_all(column_description, 'small'))) AS ns, sum(len(regexp_extract_all(column_description, 'large'))) AS nl, count_if(contains(column_description, 'small') OR contains(column_description, 'large')) AS held FROM r),
f AS (SELECT 'row_preservation' AS "check", unnest(['header_moved', 'header_moved', 'header_case_changed', 'header_inserted']) AS code, 'critical' AS severity, NULL AS id
UNION ALL SELECT 'row_preservation', 'value_changed', 'critical', source_id FROM r WHERE row_no % 5 = 0
UNION ALL SELECT 'character_policy_complete', 'invalid_name', 'major', source_id FROM r WHERE red OR row_no % 7 = 0
UNION ALL SELECT 'numeric_preservation_complete', 'numbers_changed', 'critical', source_id FROM r WHERE row_no % 8 = 0
UNION ALL SELECT 'evidence_traceable', 'invalid_status', 'major', source_id FROM r WHERE row_no % 6 = 0
UNION ALL SELECT 'evidence_traceable', 'confidence_out_of_range', 'major', source_id FROM r WHERE row_no % 120 > 100
UNION ALL SELECT 'evidence_traceable', 'keep_result_changed', 'major', source_id FROM r WHERE row_no % 3 = 0
UNION ALL SELECT 'evidence_traceable', 'change_reason_missing', 'major', source_id FROM r WHERE row_no % 3 <> 0 AND row_no % 4 = 0
UNION ALL SELECT 'evidence_traceable', 'review_reason_missing', 'major', source_id FROM r WHERE (row_no % 6 = 0 OR row_no % 10 = 0) AND row_no % 9 <> 0
UNION ALL SELECT 'evidence_traceable', 'review_reason_unexpected', 'minor', source_id FROM r WHERE row_no % 6 <> 0 AND row_no % 10 <> 0 AND row_no % 9 = 0
UNION ALL SELECT 'duplicate_consistency', 'inconsistent_names', 'major', NULL FROM (SELECT 1 FROM r GROUP BY column_name, column_description HAVING count(DISTINCT said) > 1)
UNION ALL SELECT 'terminology_frequency_verified', 'frequency_mismatch', 'major', NULL FROM t WHERE ns <> 0 OR nl <> 0
UNION ALL SELECT 'terminology_frequency_verified', 'tie_mismatch', 'major', NULL FROM t WHERE ns = nl
UNION ALL SELECT 'terminology_frequency_verified', 'selected_not_most_frequent', 'major', NULL FROM t WHERE ns < nl
UNION ALL SELECT 'terminology_frequency_verified', 'affected_missing', 'major', source_id FROM r WHERE contains(column_description, 'small') OR contains(column_description, 'large'))
SELECT "check", code, severity, count(*) AS n, count(id) AS n_rows FROM f GROUP BY ALL""")

# ranges of three digits as soon as there are over 1,000 different rows
_query(
    "f10_set_digest", "cat_part", lambda df: digests.set_digest(df, "source_id", "data_type"),
    """, h AS (SELECT sha256(concat(source_id, chr(0), data_type)) AS h FROM cat_part), p AS (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS t FROM h GROUP BY 1)
SELECT (SELECT count(*) FROM h) AS n, CASE WHEN (SELECT count(*) FROM h) <= 1000 THEN (SELECT sha256(string_agg(h, chr(10) ORDER BY h)) FROM h) ELSE (SELECT sha256(string_agg(t, chr(10) ORDER BY p)) FROM p) END AS sha256""",
)
_query("e21_job_durations", "job_log", lambda df: core.job_durations(df).withColumn("seconds", F.round("seconds", 6)), "SELECT job, round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6, 6) AS seconds, count(*) AS entries, count(DISTINCT stage) AS stages FROM job_log GROUP BY job")
_query("e22_several_descriptions", "cat_doc", lambda df: core.several_descriptions(df.withColumn("column_name", F.col("table_name"))), "SELECT table_name AS column_name, count(DISTINCT column_description) AS n_values, count(*) AS n_rows FROM cat_doc GROUP BY 1 HAVING count(DISTINCT column_description) > 1")
_query(
    "j03_incomplete_samples", "ratings korean",
    lambda r, k: review.score_ratings(
        r.unpivot(["review"], ["clarity", "tone"], "dimension", "rating"), k.sparkSession.createDataFrame([("clarity", 60.0), ("tone", 40.0)], "id string, weight double"), r.select("review", "severity"), major_rate=1.0, passing=40, least=1.0,
        incomplete=review.strata_coverage(r.filter("stratum <> 'fr' or review > 'm'").select("review", "stratum"), QUOTAS).filter("coverage < 1"), cap_incomplete=50.0,
    ),
    """, s AS (SELECT review, 60 * avg(clarity) / 5 + 40 * avg(tone) / 5 AS raw, least(avg(clarity), avg(tone)) AS lowest, count(DISTINCT stratum) FILTER (WHERE stratum IN ('de', 'en', 'es', 'fr') AND (stratum <> 'fr' OR review > 'm')) < 4 AS short, count_if(stratum <> 'fr' OR review > 'm') > 0 AS seen FROM ratings GROUP BY 1),
c AS (SELECT *, round(least(raw, CASE WHEN short AND seen THEN 50.0 ELSE 1e9 END), 6) AS score FROM s)
SELECT review, round(raw, 6) AS raw, score, round(lowest, 6) AS lowest, 0::BIGINT AS critical, score >= 40 AND lowest >= 1 AND NOT (short AND seen) AS passed FROM c""",
)
_query("c04_not_auto_confirmed", "cat_part", lambda df: N.not_auto_confirmed(df.select("source_id", F.when(every(3), "자동확정").when(every(2), "검토필요").alias("status"))), "SELECT source_id, CASE WHEN row_no % 2 = 0 THEN '검토필요' END AS status FROM cat_part WHERE row_no % 3 <> 0")


def _completeness(df: DataFrame) -> DataFrame:
    """Every 40th row listed; of these every 3rd not rated, every 5th under another id."""
    manifest = df.filter(every(40)).select((F.col("row_no") / 40).cast("long").alias("pos"), "source_id", "row_no", F.col("data_type").alias("stratum"))
    rated = manifest.filter(~every(120)).withColumn("source_id", F.when(every(200), "x").otherwise(F.col("source_id")))
    return review.sample_completeness(rated.drop("row_no"), manifest.select("pos", "source_id"), {"0": 1, "1": 100_000, "9": 1}, 100_000)


_query("j04_sample_completeness", "cat_part", _completeness, """, m AS (SELECT CAST(row_no // 40 AS BIGINT) AS pos, row_no, data_type FROM cat_part WHERE row_no % 40 = 0), r AS (SELECT * FROM m WHERE row_no % 120 <> 0),
h AS (SELECT q.s, q.n AS required, (SELECT count(*) FROM r WHERE data_type = q.s) AS n FROM (VALUES ('0', 1), ('1', 100000), ('9', 1)) q(s, n))
SELECT 'sample_order_mismatch' AS code, CAST(pos AS VARCHAR) AS details FROM m WHERE row_no % 120 = 0 OR row_no % 200 = 0 UNION ALL SELECT 'sample_too_small', CAST((SELECT count(*) FROM r) AS VARCHAR)
UNION ALL SELECT 'stratum_missing', s FROM h WHERE n = 0 UNION ALL SELECT 'stratum_short', s FROM h WHERE n > 0 AND n < required""")

_query(
    "i18_unified_names", "cat_part korean",
    lambda c, k: N.name_from_comments(c, NQ.glossary(k), c.sparkSession.createDataFrame([("size", "대형", 0), ("size", "소형", 1)], "group_id string, candidate string, candidate_order int")).select("source_id", "name", "confidence", "status", "codes"),
    NQ.NAMES + """, t AS (SELECT count_if(w1 = 'LARGE') + count_if(w2 = 'LARGE') AS l, count_if(w1 = 'SMALL') + count_if(w2 = 'SMALL') AS s FROM n), u AS (SELECT n.*, l, s, l = s AND (w1 IN ('LARGE', 'SMALL') OR w2 IN ('LARGE', 'SMALL')) AS tied FROM n, t)
SELECT source_id, CASE WHEN l >= s THEN replace(name, '소형', '대형') ELSE replace(name, '대형', '소형') END AS name, CASE WHEN red THEN 55 WHEN tied THEN 89 ELSE 96 END AS confidence,
  CASE WHEN red THEN '검증실패' WHEN tied THEN '검토필요' ELSE '자동확정' END AS status, CASE WHEN red THEN 'english_not_allowed' ELSE '' END AS codes FROM u""",
)
_query(
    "b22_units_at_terms", "cat_doc korean",
    lambda df, k: terms.units_at_terms(df, k.select(F.lower("word").alias("candidate")).union(k.sparkSession.createDataFrame([(c,) for c in ("the", "then", "there", "of")], "candidate string")), "column_description").select("source_id", F.array_join("units", chr(1)).alias("units")),
    r"""SELECT source_id, trim(regexp_replace(regexp_replace(column_description, '(there|then|the|of|anvil|blue|bolt|cold|gear|gizmo|hot|large|new|old|plate|red|ring|rod|small|widget)', concat(chr(1), '\1', chr(1)), 'g'), concat(chr(1), '+'), chr(1), 'g'), chr(1)) AS units FROM cat_doc""",
)


def _folder(spark: SparkSession) -> str:
    return f"{core.shared_folder(spark)}/{core.RUN}/{uuid.uuid4().hex}"


def _rules(df: DataFrame) -> DataFrame:
    """Rules written as a file and read again: a sense for each type, and a group for each brand with its types."""
    glossary = df.select(F.struct(F.col("table_name").alias("source"), F.lower("table_name").alias("target")).alias("g")).distinct().agg(F.array_sort(F.collect_list("g")).alias("glossary"))
    groups = df.groupBy("table_description").agg(F.array_sort(F.collect_set("table_name")).alias("candidates")).select(F.struct(F.col("table_description").alias("id"), "candidates").alias("g")).agg(F.collect_list("g").alias("synonym_groups"))
    path = _folder(df.sparkSession)
    glossary.crossJoin(groups).select(F.to_json(F.struct("glossary", "synonym_groups")).alias("value")).coalesce(1).write.text(path)  # one row a side
    senses, synonyms = catalog.read_rules(df.sparkSession, path)
    return synonyms.unionByName(senses.select(F.col("source").alias("group_id"), F.col("target").alias("candidate")), allowMissingColumns=True)


_query("a06_read_rules", "cat_part", _rules, """, g AS (SELECT DISTINCT table_description AS group_id, table_name AS candidate FROM cat_part)
SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY candidate) - 1 AS INT) AS candidate_order FROM g UNION ALL SELECT DISTINCT table_name, lower(table_name), NULL FROM cat_part""")


def _dictionary(d: DataFrame, c: DataFrame) -> DataFrame:
    path, key = _folder(d.sparkSession), ["abbreviation", "full_name", "korean_word"]
    catalog.write_dictionary(d.drop("row_no"), c.filter(F.startswith("source_id", F.lit("x-"))), path)
    read = lambda name: d.sparkSession.read.parquet(f"{path}/{name}")
    return catalog.number_rows(read("dictionary"), "pos").select("pos", *key).unionByName(read("failed").select(F.lit(0).cast("long").alias("pos"), *key))


_query("a10_write_dictionary", "dict_rows cand_part", _dictionary, "SELECT row_number() OVER (ORDER BY abbreviation, full_name, korean_word) AS pos, abbreviation, full_name, korean_word FROM dict_rows UNION ALL SELECT 0, abbreviation, full_name, korean_word FROM cand_part WHERE source_id LIKE 'x-%'")


def _results(df: DataFrame) -> DataFrame:
    path = _folder(df.sparkSession)
    catalog.write_results(df, df.select("source_id", F.lower("column_name").alias("name"), (F.col("row_no") % 100).alias("confidence")), path)
    return df.sparkSession.read.parquet(path)


_query("a11_write_results", "cat_part", _results, "SELECT *, lower(column_name) AS name, row_no % 100 AS confidence FROM cat_part")


def _population(df: DataFrame) -> DataFrame:
    path = _folder(df.sparkSession)
    catalog.write_population(df.select("row_no", "source_id", "column_name", F.when(every(3), F.col("table_name")).alias("table_name"), "column_description"), path)
    return df.sparkSession.read.text(path).select("value")


_query("a13_write_population", "cat_part", _population, """SELECT concat('{"row_no":', row_no, ',"source_id":"', source_id, '","column_name":"', column_name, CASE WHEN row_no % 3 = 0 THEN concat('","table_name":"', table_name) ELSE '' END, '","column_description":"', column_description, '"}') AS value FROM cat_part""")


def _files(df: DataFrame) -> str:
    """Folder of files with a thousand ids each, a line an id, in order."""
    path = _folder(df.sparkSession)
    rows = df.select("source_id", F.floor(F.col("row_no") / 1000).alias("block")).repartition("block").sortWithinPartitions("block", "source_id")
    rows.write.partitionBy("block").text(path)
    return path


FILES = ", f AS (SELECT CAST(sum(length(source_id) + 1) AS BIGINT) AS bytes, sha256(concat(string_agg(source_id, chr(10) ORDER BY source_id), chr(10))) AS sha256 FROM cat_part GROUP BY row_no // 1000) "
_query("a14_file_digests", "cat_part", lambda df: catalog.file_digests(df.sparkSession, _files(df)).select("bytes", "sha256"), FILES + "SELECT * FROM f")
_query(
    "a14_run_metadata", "cat_part",
    lambda df: (lambda path: catalog.run_metadata(df.sparkSession, path, path, core.catalog_profile(df).select("n_rows", "names"), {"stage": "S7", "rounds": "2"}))(_files(df)).select("n_rows", "names", "input_bytes", "output_bytes", (F.col("input_sha256") == F.col("output_sha256")).alias("same"), F.array_join(F.map_keys("options"), ",").alias("set")),
    FILES + "SELECT (SELECT count(*) FROM cat_part) AS n_rows, (SELECT count(DISTINCT column_name) FROM cat_part) AS names, CAST(sum(bytes) AS BIGINT) AS input_bytes, CAST(sum(bytes) AS BIGINT) AS output_bytes, true AS same, 'rounds,stage' AS set FROM f",
)


def _rubrics(df: DataFrame) -> DataFrame:
    """Rubrics from types: each weighted alike but for the last, which makes up the hundred; then with a weight too
    many, and with one that is listed twice."""
    each = df.groupBy(F.col("table_name").alias("id")).agg(F.count("*").alias("n"))
    sizes = each.agg(F.count("*").alias("k"), F.max("id").alias("last"))
    even = F.floor(100 / F.col("k"))
    fits = each.crossJoin(F.broadcast(sizes)).select("id", F.when(F.col("id") == F.col("last"), 100 - even * (F.col("k") - 1)).otherwise(even).alias("weight"))  # one row
    more, twice = fits.withColumn("weight", F.col("weight") + 1), fits.unionByName(fits.filter("weight > 0").orderBy("id").limit(1))
    judged = [review.validate_rubric(r).withColumn("rubric", F.lit(n)) for n, r in (("fits", fits), ("more", more), ("twice", twice))]
    return core.union_issues(*judged)


_query("j01_validate_rubric", "cat_part", _rubrics, "SELECT * FROM (VALUES ('fits', true, true), ('more', false, true), ('twice', false, false)) t(rubric, weights_ok, ids_ok) WHERE EXISTS (SELECT 1 FROM cat_part)")
_query(
    "u03_tie_resolver", "cat_doc", lambda df: terms.select_preferred_term(terms.synonym_frequency(_units(df), _synonyms(df)), lambda winners: F.element_at(winners, -1)),
    SYN + ", w AS (SELECT *, frequency = max(frequency) OVER (PARTITION BY group_id) AS won FROM freq) SELECT group_id, max_by(candidate, candidate_order) AS selected_term, max(frequency) AS frequency, count(*) > 1 AS tied, CASE WHEN count(*) > 1 THEN 'context_resolver' ELSE 'frequency' END AS selection_source FROM w WHERE won GROUP BY group_id",
)
CODES = ("timeout", "connection_error", "response_error", "model_error", "missing_result", "rejected_result", "unexpected_error", "else")
_query(
    "u05_failure_codes", "cat_part",
    lambda df: P.unanswered(df, df.filter(~every(7) & ~every(5))).join(df.select("source_id", "row_no"), "source_id").withColumn("failure_code", F.when(every(7), F.col("failure_code")).otherwise(F.element_at(F.array(*map(F.lit, CODES)), (F.col("row_no") % 8).cast("int") + 1))).select("source_id", "failure_code", N.failure_text(F.col("failure_code")).alias("label")),
    """SELECT source_id, CASE WHEN row_no % 7 = 0 THEN 'missing_result' ELSE ['timeout','connection_error','response_error','model_error','missing_result','rejected_result','unexpected_error','else'][row_no % 8 + 1] END AS failure_code,
  CASE WHEN row_no % 7 = 0 THEN '결과 누락' ELSE ['시간 초과','연결 실패','응답 형식 오류','호출 실패','결과 누락','정책 검증 거부','예상하지 못한 오류','실패'][row_no % 8 + 1] END AS label FROM cat_part WHERE row_no % 7 = 0 OR row_no % 5 = 0""",
)
_query("f12_batch_members", "cat_part", lambda df: core.batch_rows(df, 25, 8, F.col("row_no")).select("source_id", "batch"), "SELECT source_id, concat(row_no % 8, '-', CAST((row_number() OVER (PARTITION BY row_no % 8 ORDER BY row_no) - 1) // 25 AS BIGINT)) AS batch FROM cat_part")
_query("f14_output_order", "cat_part", lambda df: catalog.number_rows(core.sort_output(df.select("source_id", "column_name").repartition(5)), "pos"), "SELECT source_id, column_name, row_number() OVER (ORDER BY row_no) AS pos FROM cat_part")
