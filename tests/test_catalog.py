"""Cases of the catalog operators, and their queries against DuckDB on the smallest tables."""

import hashlib
import json

import duckdb
import pyarrow as pa
import pytest
from compare import compare, connection
from pyspark.sql import functions as F

from attrium.functions import text as X
from attrium.operators import answers as A, audit, core, dictionary as D, digests, judging, matching, naming as N, proposals as P, review, terms
from attrium.plans import more_queries as queries
from attrium.sources import catalog
from attrium.streaming.progress import stage_durations_stream, streamed_durations

SF = "/root/testdata/sf0.001"
DICT = [("DT", "DATE", "일자", 10), ("HMS", "TIME", "시각", 10), ("ORG", "ORGANIZATION", "기관", 10), ("CD", "CODE", "코드", 10)]


def test_segmentation(spark):
    names = spark.createDataFrame([(n, "t", "") for n in ("DTHMS", "ORGCD", "XYZ_DT")], "column_name string, table_name string, table_description string")
    d = spark.createDataFrame(DICT, "abbreviation string, full_name string, korean_word string, occurrence_count int")
    best = {r["column_name"]: (r["fragments"], r["covered"]) for r in D.segment_names(names, d).filter("rank = 1").collect()}
    assert best == {"DTHMS": (["DT", "HMS"], 5), "ORGCD": (["ORG", "CD"], 5), "XYZ_DT": (["XYZ", "DT"], 2)}


def test_sense_by_context(spark):
    d = spark.createDataFrame([("AP", "APPLICATION", "적용", 10), ("AP", "APPROVAL", "승인", 1)], "abbreviation string, full_name string, korean_word string, occurrence_count int")
    row = D.resolve_sense(spark.createDataFrame([("AP", "T", "계약 승인 정보")], "fragment string, table_name string, table_description string"), d).first()
    assert row["full_name"] == "APPROVAL" and row["many"]


def test_korean_names(spark):
    cases = [(["최종", "적재"], "최종적재"), (["일자", "시각"], "일시"), (["코드", "코드"], "코드"), ([None], "미정")]
    got = spark.createDataFrame(cases, "p array<string>, want string").select(X.join_korean_name(F.col("p")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_majority_name(spark):
    rows = [("1", "ABC", "ALPHA", "항목"), ("2", "ABC", "ALPHA", "항목"), ("3", "ABC", "ALPHABET", "항목")]
    out = D.reconcile_full_name(spark.createDataFrame(rows, "source_id string, abbreviation string, full_name string, korean_word string")).collect()
    assert {r["full_name"] for r in out} == {"ALPHA"} and sum(r["cause"] == "majority" for r in out) == 1


def test_preferred_term(spark):
    units = spark.createDataFrame([("1", ["납입", "금"], 2), ("2", ["납부", "금"], 3)], "source_id string, units array<string>, weight int")
    syn = spark.createDataFrame([("g", "납입", 0), ("g", "납부", 1)], "group_id string, candidate string, candidate_order int")
    assert {r["name"] for r in terms.reconcile_terms(units, syn)[0].collect()} == {"납부금"}


SYN = [("차량", "차", 0), ("차량", "차량", 1), ("낸", "납입", 0), ("낸", "납부", 1)]
RESULTS = "source_id string, units array<string>, weight int, original_description string, action string, reason string"


@pytest.mark.parametrize("most", [terms.MOST_CANDIDATES, 0])
def test_reconciled_terms_say_why(spark, most):
    """Whole units only; units count, not rows; a kept row becomes normalised; decisions for groups in use."""
    rows = [("1", ["차", "형태", "코드"], 1, "차형태코드", "유지", "kept"), ("2", ["차량", "차량"], 1, "", "재작성", "why"), ("3", ["차액"], 10, "", "유지", "kept"), ("4", [], 1, "", "유지", "kept")]
    syn = spark.createDataFrame(SYN, "group_id string, candidate string, candidate_order int")
    out, decisions = terms.reconcile_terms(spark.createDataFrame(rows, RESULTS), syn, most=most)
    got = {r["source_id"]: (r["name"], r["action"], r["reason"], r["replaced"]) for r in out.collect()}
    assert got == {"1": ("차량형태코드", "정규화", "용어 통일 빈도 기준 차량:차량 (frequency)", 1), "2": ("차량차량", "재작성", "why", 0), "3": ("차액", "유지", "kept", 0), "4": ("", "유지", "kept", 0)}
    assert sorted((r["source_id"], r["group_id"], r["frequency"]) for r in decisions.collect()) == [("1", "차량", 2), ("2", "차량", 2)]


@pytest.mark.parametrize("most", [terms.MOST_CANDIDATES, 0])
def test_ties(spark, most):
    """The rule first, then the row's own texts, then the order; a rule may only name a winner."""
    syn = spark.createDataFrame(SYN, "group_id string, candidate string, candidate_order int")
    rows = spark.createDataFrame([("1", ["차", "납입"], 5, "차량형태코드", "유지", ""), ("2", ["차량", "납부"], 5, "", "유지", "")], RESULTS)
    of = lambda **k: {(r["source_id"], r["group_id"]): (r["selected_term"], r["selection_source"], r["tied"]) for r in terms.reconcile_terms(rows, syn, most=most, **k)[1].collect()}
    assert of() == {("1", "차량"): ("차량", "context_evidence", True), ("1", "낸"): ("납입", "context_evidence", True), ("2", "차량"): ("차량", "context_evidence", True), ("2", "낸"): ("납부", "context_evidence", True)}
    assert set(of(resolver=terms.first_listed).values()) == {("차", "context_resolver", True), ("납입", "context_resolver", True)}
    even = spark.createDataFrame([("1", ["차", "차량"], 5, "", "유지", "")], RESULTS)
    assert [tuple(r)[1:3] for r in terms.reconcile_terms(even, syn, most=most)[1].select("group_id", "selected_term", "selection_source").collect()] == [("차", "deterministic_fallback")]
    with pytest.raises(Exception, match="none of the winners"):
        of(resolver=lambda w: F.lit("차액"))


def test_comment_issues(spark):
    cases = [
        ("a/b", "가", "재작성", "why", ["x"], {"numeric": 0}, set()),
        ("가/나", "가나", "재작성", "why", ["x"], {}, {"slash_alternatives_not_resolved"}),
        ("가/나", "가", "재작성", "", ["x"], {}, {"change_reason_missing", "slash_selection_evidence_missing"}),
        ("가ゟ", "가ゟ", "유지", "", [], {}, {"invalid_character", "noncanonical_unicode"}),
        ("가あ", "가あ", "유지", "", [], {}, {"invalid_character"}),
        ("가1", "나2", "정규화", "why", [], {}, {"numeric_sequence_mismatch"}),
        ("가", "나", "유지", "", [], {}, {"keep_result_changed"}),
    ]
    df = spark.createDataFrame([(str(i), c[0], c[0], c[1], c[2], c[3], c[4], ["added"] if i == 0 else []) for i, c in enumerate(cases)], "source_id string, column_description string, original_description string, name string, action string, reason string, review_reasons array<string>, added_concepts array<string>")
    got = {}
    for r in terms.comment_issues(df).collect():
        got.setdefault(r["source_id"], set()).add(r["code"])
    assert {str(i): c[6] | ({"semantic_scope_change_reported"} if i == 0 else set()) for i, c in enumerate(cases)} == {str(i): got.get(str(i), set()) for i in range(len(cases))}


def test_risks(spark):
    cases = [(None, ["empty_description"], "critical"), (" ", ["whitespace"], "medium"), ("가/나", ["slash_ambiguity", "special_symbol"], "high"), ("고객ID", [], "low"), ("IDX값1", ["english_translation_required", "numeric_sensitive"], "high"), ("ＡＢ", ["unicode_normalization", "english_translation_required"], "high"), ("가あ", ["unsupported_character"], "medium"), ("가,나", ["special_symbol"], "medium")]
    got = spark.createDataFrame([(c[0],) for c in cases], "c string").select(X.classify_risk(F.col("c")).alias("r")).collect()
    assert [(r["r"]["codes"], r["r"]["level"]) for r in got] == [c[1:] for c in cases]


CATALOG = "row_no long, source_id string, column_name string, table_name string, table_description string, data_type string, column_description string"


def test_no_row_is_lost(spark):
    """Null tables, names without letters and null names have results; unknown tokens have the placeholder."""
    rows = [(1, "a", "ORGCD", "T", "d", "s", ""), (2, "b", "ORGCD", None, None, None, None), (3, "c", "__", "T", "d", "s", ""), (4, "e", None, "T", "d", "s", ""), (5, "f", "XYZ_DT", "T", "d", "s", "")]
    df, d = spark.createDataFrame(rows, CATALOG), spark.createDataFrame(DICT, "abbreviation string, full_name string, korean_word string, occurrence_count int")
    got = {r["source_id"]: (r["english_full_name"], r["korean_attribute_name"], r["confidence"], r["review_stratum"]) for r in D.deterministic_results(df, d).collect()}
    whole = ("ORGANIZATION CODE", "기관코드", 85, "deterministic")
    assert got == {"a": whole, "b": whole, "c": ("__", "미정", 0, "unmapped_inference"), "e": ("", "미정", 0, "unmapped_inference"), "f": ("XYZ DATE", "미정일자", 8, "unmapped_inference")}
    base = {r["source_id"]: (r["english_full_name"], r["korean_attribute_name"], r["confidence"]) for r in D.direct_baseline(df, d).collect()}
    assert base == {"a": ("ORGCD", "미정", 25), "b": ("ORGCD", "미정", 25), "c": ("", "미정", 80), "e": ("", "미정", 80), "f": ("XYZ DATE", "미정일자", 25)}
    strata = {r["source_id"]: r["review_stratum"] for r in D.assign_strata(D.deterministic_results(df, d)).collect()}
    assert strata == {"a": "duplicate_context", "b": "duplicate_context", "c": "review_needed", "e": "review_needed", "f": "review_needed"}
    named = {r["source_id"]: r["status"] for r in P.name_from_dictionary(df, d).collect()}
    assert set(named) == set("abcef") and named["c"] == "검증실패"


def test_failures_are_those_of_a_candidate(spark):
    """One bad candidate leaves its source's good ones; a source without candidates has a row of its own."""
    sources = spark.createDataFrame([(1, "1", "DTYN", "", "", "", "일자 여부"), (2, "2", "ZZ", "", "", "", "x")], CATALOG)
    rows = [("1", "DT", "DATE", "일자"), ("1", "XYZ", "DATE", "일자"), ("9", "DT", "DATE", "일자")]
    c = spark.createDataFrame(rows, "source_id string, abbreviation string, full_name string, korean_word string")
    failed, valid = D.partition_failed(sources, c, D.mapping_issues(sources, c))
    assert sorted(tuple(r) for r in failed.collect()) == [("1", "XYZ", "DATE", "일자", "abbreviation_not_in_column"), ("2", None, None, None, "missing_source_mapping")]
    assert sorted(tuple(r) for r in valid.collect()) == [rows[0], rows[2]]


def test_model_hook(spark):
    """A batch that fails keeps its failure to itself; answers in either form are read; what isn't answered is known."""
    df = spark.createDataFrame([(i, f"r{i}", "x") for i in range(40)], "row_no long, source_id string, request string")

    def model(part):
        if "r3" in set(part["source_id"]):
            raise TimeoutError
        ids = [i for i in part["source_id"] if i != "r5"]
        return [json.dumps({"resolutions": [{"id": i, "c": [["A", "B", "가", "mapping"]]} for i in ids]})]

    answers = P.propose(df, model, batch=3)
    good, unread = P.decode_resolutions(answers)
    codes = [r["failure_code"] for r in answers.collect()]
    assert codes.count("timeout") == 1 and set(codes) == {"", "timeout"}
    found = {r["source_id"] for r in good.collect()}
    lost = {r["source_id"] for r in P.unanswered(df, good).collect()}
    assert found | lost == {f"r{i}" for i in range(40)} and {"r3", "r5"} <= lost and len(lost) <= 4 and unread.count() == 1
    assert [A.failure_code(e) for e in (ConnectionError(), ValueError(), RuntimeError(), KeyError())] == ["connection_error", "response_error", "model_error", "unexpected_error"]


def unsteady(log):
    """A model that answers about half of its requests, others each time, some twice, and notes all that it was asked;
    and what it was asked."""
    log.mkdir()

    def model(part):
        import random
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(part["source_id"]))
        found = [{"id": i, "c": [["A", f"N{random.random()}", "가", "inference"]]} for i in part["source_id"] for _ in range(random.randrange(3))]
        return [json.dumps({"resolutions": found})]

    return model, lambda: sorted(i for f in log.iterdir() for i in f.read_text().split("\n"))


def test_answers_are_asked_once(spark, tmp_path):
    """Several actions and readers, a run that goes on after another, and tasks that fail after the model answered."""
    ids = sorted(f"r{i}" for i in range(40))
    (model, asked), df = unsteady(tmp_path / "log"), spark.createDataFrame([(int(i[1:]), i, "x") for i in ids], "row_no long, source_id string, request string")
    folder = str(tmp_path / "answers")
    found = P.propose(df.filter("row_no < 25"), model, batch=7, answers=A.Answers(spark, folder), round_=1)
    assert sorted(map(tuple, found.select("batch", "answer").collect())) == sorted(map(tuple, found.select("batch", "answer").collect()))
    again = P.propose(df, model, batch=7, answers=A.Answers(spark, folder), round_=1)
    assert asked() == ids and sorted(i for r in again.collect() for i in r["source_ids"]) == ids
    assert P.propose(df, model, answers=A.Answers(spark, folder), round_=1).count() == again.count() and asked() == ids
    P.propose(df, model, answers=A.Answers(spark, folder), round_=2)
    assert asked() == sorted(ids * 2)
    # a task that dies after its batch was answered takes the answer when it runs again
    path, calls = f"file:{tmp_path}/pending", []
    give = lambda: calls.append(1) or {"answer": f"a{len(calls)}", "failure_code": ""}
    assert A._asked(path, "x", give) == A._asked(path, "x", give) == {"answer": "a1", "failure_code": ""} and len(calls) == 1


def test_batches_are_asked_in_many_tasks(spark):
    """Small requests don't end up in a task or two, one model call after the other."""
    df = spark.range(2000).selectExpr("id AS row_no", "concat('r', id) AS source_id", "'x' AS request")

    def model(part):
        from pyspark import TaskContext

        return [str(TaskContext.get().partitionId())]

    found = P.propose(df, model, batch=2)
    assert found.select("answer").distinct().count() > 16 and found.select(F.explode("source_ids")).distinct().count() == 2000


def test_a_broken_round_goes_on(spark, tmp_path):
    """The run breaks off while a round is asked: batches that were answered aren't asked again."""
    ids = sorted(f"r{i}" for i in range(30))
    (model, asked), df = unsteady(tmp_path / "log"), spark.createDataFrame([(int(i[1:]), i, "x") for i in ids], "row_no long, source_id string, request string")

    def breaks(part):
        if "r7" in set(part["source_id"]):
            raise SystemExit  # not an answer: the task ends
        return model(part)

    with pytest.raises(Exception):  # noqa: B017
        P.propose(df, breaks, batch=3, answers=A.Answers(spark, str(tmp_path / "answers")))
    before = asked()
    found = P.propose(df, model, batch=3, answers=A.Answers(spark, str(tmp_path / "answers")))
    assert asked() == ids and len(before) < len(ids) and sorted(i for r in found.collect() for i in r["source_ids"]) == ids


def test_unsteady_model_loses_no_row(spark, tmp_path):
    (model, asked), df = unsteady(tmp_path / "log"), spark.createDataFrame([(i, f"r{i}", 10) for i in range(40)], "row_no long, source_id string, confidence int")

    def propose(todo):
        given = P.decode_resolutions(P.propose(todo.withColumn("request", F.lit("x")), model, batch=6))[0]
        return todo.join(given.select("source_id", F.lit(20).alias("_c")), "source_id").select("row_no", "source_id", F.col("_c").alias("confidence"))

    out = N.review_loop(df, lambda r: r.filter("confidence < 90"), propose, 1).collect()
    assert sorted(r["source_id"] for r in out) == sorted(f"r{i}" for i in range(40)) == asked()


def test_only_touched_keys_are_judged_again(spark):
    """The same findings as of the whole table, from rows in proportion to those that changed."""
    rows = [(f"r{i}", i % 7, i // 3, i % 5) for i in range(90)]
    before = spark.createDataFrame(rows, "source_id string, v int, g int, w int")
    seen = []

    def row_rule(r):
        seen.append(r.count())
        return core.issue(r.filter("v < 2"), "small")

    def group_rule(r):
        seen.append(r.count())
        return r.groupBy("g").agg(F.count_distinct("w").alias("n")).filter("n > 2").select("g", F.lit("mixed").alias("code"), F.lit("error").alias("severity"))

    rules = [judging.Rule("row", ("source_id",), row_rule), judging.Rule("group", ("g",), group_rule)]
    # rows change, one moves to another group, one to none, one goes, one comes
    after = spark.createDataFrame([(i, 0 if i == "r4" else v, {"r5": 20, "r6": None}.get(i, g), 0 if i == "r40" else w) for i, v, g, w in rows if i != "r50"] + [("new", 1, 9, 7)], "source_id string, v int, g int, w int")
    touched = spark.createDataFrame([(i,) for i in ("r4", "r5", "r6", "r40", "r50", "new")], "source_id string")
    found = judging.judged(before, rules)
    whole = sorted(map(tuple, judging.judged(after, rules).collect()), key=repr)
    del seen[:]
    assert sorted(map(tuple, judging.judged_again(found, before, after, touched, rules).collect()), key=repr) == whole
    assert seen[0] == 5 and seen[1] <= 25


def test_review_rounds_with_a_model(spark, tmp_path):
    """Names by a model that mends a row in each round; what it is asked says what was wrong."""
    d = spark.createDataFrame(DICT, "abbreviation string, full_name string, korean_word string, occurrence_count int")
    df = spark.createDataFrame([(1, "a", "ORGCD", "T", "d", "s", ""), (2, "b", "QQQ", "T", "d", "s", ""), (3, "c", "ZZDT", "T", "d", "s", "")], CATALOG)

    def model(part):
        out = []
        for i, text in zip(part["source_id"], part["request"], strict=True):
            asked = json.loads(text)
            assert "placeholder_korean_name" in {x["code"] for x in asked["issues"]}
            if asked["round"] == 2 or i == "b":
                out.append({"id": i, "c": [["QQQ", "QUEUE", "대기", "inference"]] if i == "b" else [["ZZ", "ZONE", "구역", "inference"], ["DT", "DATE", "일자", "mapping"]]})
        return [json.dumps({"resolutions": out})]

    answers = A.Answers(spark, str(tmp_path / "answers"))
    out = {r["source_id"]: (r["english_full_name"], r["confidence"], r["status"]) for r in P.name_from_dictionary(df, d, review=P.reviewer(df, d, model, answers), rounds=3).collect()}
    assert out == {"a": ("ORGANIZATION CODE", 85, "자동확정"), "b": ("QUEUE", 86, "검토필요"), "c": ("ZONE DATE", 86, "검토필요")}
    assert [answers.of(n).select(F.explode("source_ids")).count() for n in (1, 2, 3)] == [2, 1, 0]

    def silent(part):
        raise AssertionError("asked again")

    same = P.name_from_dictionary(df, d, review=P.reviewer(df, d, silent, answers), rounds=3)
    assert {r["source_id"]: (r["english_full_name"], r["confidence"], r["status"]) for r in same.collect()} == out


@pytest.mark.parametrize("shard", [matching.SHARD, 7])
def test_terms_by_automaton(spark, shard):
    """Of a group's terms the leftmost, then the longest, none within another; groups and rows stay apart."""
    import random
    import re

    rng = random.Random(3)
    rules = [("a", "ab"), ("a", "abc"), ("a", "c"), ("b", "bc"), ("b", "ca"), ("b", "a.b"), ("c", "차"), ("c", "차량"), ("c", "ab"), ("a", ""), ("a", "ab"), ("d", None)]
    texts = [(f"r{i % 37}", "".join(rng.choice(["a", "b", "c", ".", "차", "량", "x"]) for _ in range(rng.randrange(30)))) for i in range(40)] + [("n", None), ("e", "")]
    want = []
    for g in "abc":
        own = sorted({t for h, t in rules if h == g and t}, key=lambda t: -len(t))
        want += [(i, g, m.group(), m.start()) for i, t in texts for m in re.finditer("|".join(map(re.escape, own)), t or "")]
    df = spark.createDataFrame(texts, "source_id string, column_description string")
    found = matching.find_terms(df, spark.createDataFrame(rules, "group_id string, candidate string"), shard=shard)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
    assert matching.find_terms(df, spark.createDataFrame([], "group_id string, candidate string")).count() == 0


def test_a_hundred_thousand_candidates(spark):
    terms_ = spark.range(100_000).select((F.col("id") % 20_000).cast("string").alias("group_id"), F.concat(F.lit("t"), F.col("id"), F.lit(";")).alias("candidate"))
    df = spark.range(2_000).select(F.concat(F.lit("r"), "id").alias("source_id"), F.concat(F.lit("x t"), F.col("id") * 40, F.lit("; t"), F.col("id") * 40 + 1, F.lit(";")).alias("column_description"))
    assert terms.surface_frequency(df, terms_).agg(F.count("*"), F.sum("n")).first()[:] == (4_000, 4_000)
    decisions = terms_.groupBy("group_id").agg(F.min("candidate").alias("selected_term")).select("group_id", "selected_term", F.create_map("selected_term", F.lit(0)).alias("frequencies"), F.lit(False).alias("tied"))
    codes = {r["code"] for r in audit.terminology_audit(df, df.select("source_id", F.lit("").alias("name")), terms_, decisions).select("code").distinct().collect()}
    assert codes == {"frequency_mismatch", "candidates_mismatch", "tie_mismatch", "selected_term_absent"}


def test_headers():
    same = ["a", "b", "c", "d"]
    assert audit.header_issues(same, [*same, "new"]) == []
    assert audit.header_issues(same, ["a", "b", "d"]) == [("header_missing", "c")]
    assert audit.header_issues(same, ["a", "B", "c", "d"]) == [("header_case_changed", "b")]
    assert audit.header_issues(same, ["b", "a", "c", "d"]) == [("header_moved", "a"), ("header_moved", "b")]
    assert audit.header_issues(same, ["a", "x", "b", "c", "d", "y"]) == [("header_inserted", "x")]
    assert audit.header_issues(same, []) == [("header_missing", h) for h in same]


def test_repaired_names_are_judged_again(spark):
    """Failed rows take accepted proposals, others stay; strata and status of all are worked out anew."""
    d = spark.createDataFrame(DICT, "abbreviation string, full_name string, korean_word string, occurrence_count int")
    df = spark.createDataFrame([(i + 1, s, n, "T", "d", "s", "") for i, (s, n) in enumerate((("a", "ORGCD"), ("b", "ZZDT"), ("c", "QQQ"), ("e", "DTHMS")))], CATALOG)
    kept = "ORG→ORGANIZATION→기관[mapping] | CD→CODE→코드[mapping]"
    rows = [("a", "ORGCD", "ORGANIZATION CODE", "기관코드", "자동확정", 100, kept), ("b", "ZZDT", "", "", "검증실패", 0, ""), ("c", "QQQ", "", "", "검증실패", 0, ""), ("e", "DTHMS", "WRONG", "잘못", "자동확정", 100, "DTHMS→WRONG→잘못[mapping]")]
    old = N.read_results(spark.createDataFrame(rows, "source_id string, column_name string, english_full_name string, korean_attribute_name string, status string, confidence int, evidence string"))
    part = "array<struct<fragment:string,full:string,korean:string,origin:string>>"
    given = spark.createDataFrame([("b", [("ZZ", "ZONE", "구역", "inference"), ("DT", "DATE", "일자", "mapping")]), ("a", [("ORGCD", "NO", "아니", "inference")])], f"source_id string, components {part}")
    out = {r["source_id"]: (r["english_full_name"], r["status"], r["validation_codes"]) for r in P.repair_names(old, df, given, d).collect()}
    assert out["a"] == ("ORGANIZATION CODE", "자동확정", "") and out["b"] == ("ZONE DATE", "검토필요", "low_confidence")
    assert out["c"][1] == "검증실패" and "empty_full_name" in out["c"][2] and out["e"] == ("WRONG", "검증실패", "mapping_evidence_mismatch")
    with pytest.raises(ValueError, match="differ"):
        P.repair_names(old.filter("source_id = 'a'"), df, given, d)


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"glossary": [{"source": "FY", "target": "회계"}], "synonym_groups": [{"id": "g", "candidates": ["차", "차량"]}]}))
    glossary, synonyms = catalog.read_rules(spark, str(path))
    assert [tuple(r) for r in glossary.collect()] == [("FY", "회계")] and sorted(tuple(r) for r in synonyms.collect()) == [("g", "차", 0), ("g", "차량", 1)]
    assert catalog.read_rules(spark, None)[0].count() == 0 == catalog.read_rules(spark, str(tmp_path / "no"), optional=True)[1].count()
    with pytest.raises(FileNotFoundError):
        catalog.read_rules(spark, str(tmp_path / "no"))
    path.write_text("{\"other\": []}")
    with pytest.raises(ValueError, match="other"):
        catalog.read_rules(spark, str(path))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("column name (*),note\n a_b ,x\n,\n ,y\nc,z\n")
    good, bad = catalog.read_catalog(spark, str(tmp_path / "in.csv"), "csv", ["columnname"], "columnname", header="true")
    assert [(r["source_id"], r["columnname"]) for r in good.collect()] == [("row-1", "A_B"), ("row-4", "C")] and [r["source_id"] for r in bad.collect()] == ["row-3"]
    for policy, text in (("fail", "row 3 has no"), ("collect", "1 rows have no columnname: 3")):
        with pytest.raises(ValueError, match=text):
            catalog.read_catalog(spark, str(tmp_path / "in.csv"), "csv", ["columnname"], "columnname", policy=policy, header="true")
    with pytest.raises(ValueError, match="missing headers: other"):
        catalog.read_catalog(spark, str(tmp_path / "in.csv"), "csv", ["other"], "columnname", header="true")
    catalog.write_results(good, good.select("source_id", F.lit("n").alias("name")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["source_id", "note", "columnname", "row_no", "name"] or spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="differ"):
        catalog.write_results(good, good.limit(1).select("source_id"), str(tmp_path / "bad"))
    d = spark.createDataFrame(DICT, "abbreviation string, full_name string, korean_word string, occurrence_count int")
    catalog.write_dictionary(d, d.limit(0), str(tmp_path / "dict"))
    assert catalog.read_dictionary(spark.read.parquet(str(tmp_path / "dict/dictionary"))).count() == len(DICT)
    with pytest.raises(ValueError):
        catalog.write_dictionary(d.limit(0), d.limit(0), str(tmp_path / "none"))
    catalog.write_population(good, str(tmp_path / "population"))
    catalog.write_blind_sample(good.withColumn("status", F.lit("s")), ["clarity"], str(tmp_path / "blind"))
    assert "status" not in spark.read.option("header", "true").csv(str(tmp_path / "blind")).columns
    meta = catalog.run_metadata(spark, str(tmp_path / "in.csv"), str(tmp_path / "dict"), good.agg(F.count("*").alias("n")), {"a": "b"}).first()
    assert meta["n"] == 2 and meta["input_bytes"] == 39 and len(meta["output_sha256"]) == 64 and meta["options"] == {"a": "b"}


def test_rubric_and_completeness(spark):
    rubric = lambda rows: tuple(review.validate_rubric(spark.createDataFrame(rows, "id string, weight double")).first())
    assert rubric([("x", 60.0), ("y", 40.0)]) == (True, True) and rubric([("x", 60.0), ("x", 30.0)]) == (False, False)
    manifest = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, source_id string")
    rated = spark.createDataFrame([(0, "a", "en"), (1, "c", "en")], "pos int, source_id string, stratum string")
    got = sorted(tuple(r) for r in review.sample_completeness(rated, manifest, {"en": 3, "de": 1, "fr": 0}, 3).collect())
    assert got == [("sample_order_mismatch", "1"), ("sample_order_mismatch", "2"), ("sample_too_small", "2"), ("stratum_missing", "de"), ("stratum_short", "en")]


def test_progress_stream(spark, tmp_path):
    schema = "job long, stage string, ts timestamp"
    for day in (1, 2):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / f"{day}.json").write_text("\n".join(json.dumps({"job": j, "stage": s, "ts": f"2026-01-0{day}T00:00:0{k}Z"}) for j in (1, 2) for k, s in enumerate("ab")))
        stage_durations_stream(spark, str(tmp_path / "log"), schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    # late entries: before all of a job's, between two, and at the time of another
    late = [(1, "z", "2026-01-01T00:00:00Z"), (1, "m", "2026-01-01T12:00:00Z"), (2, "a", "2025-12-31T00:00:00Z"), (2, "a", "2026-01-01T00:00:00Z"), (3, "only", "2026-01-01T00:00:00Z")]
    (tmp_path / "log" / "3.json").write_text("\n".join(json.dumps(dict(zip(("job", "stage", "ts"), r, strict=True))) for r in late))
    query = stage_durations_stream(spark, str(tmp_path / "log"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == len(late)
    batch = core.stage_durations(spark.read.schema(schema).json(str(tmp_path / "log")))
    assert sorted(map(tuple, streamed_durations(spark.read.parquet(str(tmp_path / "out"))).collect())) == sorted(map(tuple, batch.collect()))
    jobs = {r["job"]: (r["seconds"], r["entries"], r["stages"]) for r in core.job_durations(spark.read.schema(schema).json(str(tmp_path / "log"))).collect()}
    assert jobs == {1: (86401.0, 6, 4), 2: (172801.0, 6, 2), 3: (0.0, 1, 1)}


def test_digests(spark):
    """The same from any partitioning and order, other for any change; nulls and repeated rows count."""
    ids = spark.range(5_000).select(F.concat(F.lit("r"), "id").alias("a"), (F.col("id") % 3).alias("b"))
    of = lambda df: tuple(digests.set_digest(df, "a", "b").first())
    whole = of(ids.repartition(1))
    assert whole == of(ids.repartition(200)) == of(ids.orderBy(F.desc("a"))) and whole[0] == 5_000
    others = [of(ids.filter("a != 'r7'")), of(ids.unionByName(ids.filter("a = 'r7'"))), of(ids.withColumn("b", F.when(F.col("a") != "r7", F.col("b")))), of(ids.limit(0))]
    assert len({whole, *others}) == 5
    seq = spark.range(2_500).select(F.col("id").alias("pos"), F.concat(F.lit("r"), "id").alias("a"))
    in_order = tuple(digests.sequence_digest(seq, "pos", "a").first())
    swapped = seq.withColumn("pos", F.when(F.col("pos") < 2, 1 - F.col("pos")).otherwise(F.col("pos")))
    assert in_order == tuple(digests.sequence_digest(seq.repartition(50), "pos", "a").first()) != tuple(digests.sequence_digest(swapped, "pos", "a").first())


def test_one_flat_digest_over_any_number_of_ids(spark):
    """SHA-256 over all sorted hashes; repeated ids count as often as they come, and no rows give the hash of nothing."""
    of = lambda df: tuple(digests.sorted_digest(df, "a").first())
    ids = [f"r{i}" for i in range(5_000)] + ["r7"] * 10_000 + ["r8*2"]
    want = hashlib.sha256("\n".join(sorted(hashlib.sha256(x.encode()).hexdigest() for x in ids)).encode()).hexdigest()
    df = spark.createDataFrame([(x,) for x in ids], "a string")
    assert of(df) == of(df.repartition(30)) == (15_001, want)
    assert of(df.limit(0)) == (0, hashlib.sha256().hexdigest())


def test_digest_of_positions_beyond_a_million(spark):
    """Blocks of a thousand positions under one hash, wherever the last position lies."""
    rows = [(i * 700, f"r{i}*2") for i in range(2_000)]
    blocks = {}
    for pos, a in rows:
        blocks.setdefault(pos // 1000, []).append(f"{pos}:{a}")
    want = hashlib.sha256("\n".join(hashlib.sha256("\n".join(b).encode()).hexdigest() for b in blocks.values()).encode()).hexdigest()
    assert tuple(digests.sequence_digest(spark.createDataFrame(rows, "pos long, a string").repartition(9), "pos", "a").first()) == (2_000, want)


def test_locked_sample(spark):
    df = spark.createDataFrame([(f"r{i}", i) for i in range(30)], "source_id string, v int")
    manifest = spark.createDataFrame([(k, f"r{i}") for k, i in enumerate((5, 3, 17, 0))], "pos int, source_id string")
    lock = core.cut(N.lock_manifest(manifest, "S1"))
    assert [r["source_id"] for r in N.locked_sample(df, manifest, lock, "S1").collect()] == ["r5", "r3", "r17", "r0"]
    with pytest.raises(ValueError, match="stage S1, not S2"):
        N.locked_sample(df, manifest, lock, "S2")
    with pytest.raises(ValueError, match="isn't the one"):
        N.locked_sample(df, manifest.withColumn("pos", 3 - F.col("pos")), lock, "S1")
    with pytest.raises(ValueError, match="missing from the population: r17"):
        N.locked_sample(df.filter("v != 17"), manifest, lock, "S1")


def test_fan_out_keeps_rows(spark):
    df = spark.createDataFrame([(i, f"r{i}", "A" if i % 3 else None, "d", "t", "u", "v") for i in range(30)], "row_no long, source_id string, column_name string, column_description string, table_name string, table_description string, data_type string")
    for mode in ("mapping", "context", "comment"):
        assert core.fan_out(df.select("source_id", "column_name"), core.dedup_sources(df, mode)).count() == 30


def test_names_from_comments(spark):
    """Slash, glossary, repeated grade; null, empty and symbols only; ID stays."""
    g = spark.createDataFrame([("FY", "회계"), ("sms", "문자메시지")], "source string, target string")
    cases = [("FY년도", "회계년도", "재작성", 96), ("SMS수신여부", "문자메시지수신여부", "재작성", 96), ("차대번호/임시번호", "차대번호", "재작성", 85), ("우대등급등급코드", "우대등급코드", "정규화", 96), ("고객ID", "고객ID", "유지", 100), ("XY 값", "XY값", "재작성", 55), (None, "", "유지", 100), ("", "", "유지", 100), ("/", "", "재작성", 85)]
    df = spark.createDataFrame([(f"r{i}", c[0]) for i, c in enumerate(cases)], "source_id string, column_description string")
    got = {r["source_id"]: (r["name"], r["action"], r["confidence"]) for r in N.deterministic_names(df, g).collect()}
    assert got == {f"r{i}": c[1:] for i, c in enumerate(cases)}
    assert N.deterministic_names(df.limit(0), g).count() == 0


def test_semantic_units(spark):
    row = spark.createDataFrame([("차량형태코드차",), ("",)], "c string").select(N.semantic_units(F.col("c"), ["차", "차량"]).alias("u")).collect()
    assert [r["u"] for r in row] == [["차량", "형태코드", "차"], [""]]


def test_units_at_many_terms(spark):
    """As with a pattern, by an automaton of 30,000 terms; repeated, empty and null texts; other planes."""
    texts = ["차량형태코드차", "", None, "차량차", "형태", "x😀차😀", "차량형태코드차", "차", "aab"]
    df = spark.createDataFrame(list(enumerate(texts)), "source_id long, name string")
    few = ["차", "차량", "a", "ab", "aa"]
    rules = spark.range(30_000).select(F.concat(F.lit("q"), "id").alias("candidate")).union(spark.createDataFrame([(c,) for c in [*few, None, ""]], "candidate string"))
    got = {r[0]: r[1:] for r in terms.units_at_terms(df, rules).collect()}
    assert got == {r[0]: r[1:] for r in df.select("*", N.semantic_units(F.col("name"), few)).collect()}
    assert terms.units_at_terms(df.limit(0), rules).count() == 0 and terms.units_at_terms(df, rules.limit(0)).filter("units[0] <=> name and size(units) = 1").count() == 9
    assert got[8] == ("aab", ["aa", "b"]) and got[5][1] == ["x😀", "차", "😀"] and got[2] == (None, [None])


@pytest.mark.parametrize("shard", [matching.SHARD, 3])
def test_texts_cut_where_they_are_read(spark, shard):
    """No text is shuffled to be cut, and with many automata the units are the same."""
    texts = [(i, t * 50) for i, t in enumerate(["x차량차 ", "차량형", "", "다른 글", "차량형"])] + [(9, None)]
    df = spark.createDataFrame(texts, "source_id long, name string")
    few = ["차", "차량", "량형", "다른"]
    out = matching.cut_at_terms(df, spark.createDataFrame([(c,) for c in few], "candidate string"), "name", shard)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.select("*", N.semantic_units(F.col("name"), few)).collect()), key=str)
    if shard == matching.SHARD:
        assert "Exchange" not in out._jdf.queryExecution().toString()


def test_long_texts_are_searched_a_few_at_a_time():
    """A task turns about SLICE bytes of text into Python objects at a time, and puts out few hits at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * 6), pa.array(["x" * (matching.SLICE // 3)] * 6)], names=["row", "text"])
    assert [b.num_rows for b in matching._slices([batch], 1)] == [2, 2, 2]
    assert [b.num_rows for b in matching._slices([batch], 0)] == [6] and matching.ROWS <= 10_000


ODD = {
    "no word": ["the of", "12 éé.", ""],
    "null": ["the of", None, None, None, None, None],  # rows 5 and 10 get their source too
    "tie": ["none the of", "never", "None", "never none, never"],
    "dotted I": ["wİth İof ofİ the", "THAT of"],
}


@pytest.mark.parametrize("name", ["e06_synonym_frequency", "f04_preferred_term", "i10_reconcile_terms", "i10_decisions"])
@pytest.mark.parametrize("texts", ODD.values(), ids=ODD)
def test_terms_of_odd_texts(spark, tmp_path, name, texts):
    rows = [(i, t, None if i == 10 else "en", f"the{i}") for i, t in enumerate(texts, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), queries.QUERIES[name], queries.ORACLES[name]) == ""


@pytest.mark.parametrize("most", [terms.MOST_CANDIDATES, 0])
def test_ties_without_evidence(spark, most):
    """No points for any text: the order settles ties. Of the texts with points only those are asked."""
    syn = spark.createDataFrame(SYN, "group_id string, candidate string, candidate_order int")
    rows = spark.createDataFrame([("1", ["차"], 5, "차량형태코드", "유지", ""), ("2", ["차량"], 5, "", "유지", "")], RESULTS)
    of = lambda e: sorted((r["source_id"], r["selected_term"], r["selection_source"]) for r in terms.reconcile_terms(rows, syn, most=most, evidence=e)[1].collect())
    assert of({}) == [("1", "차", "deterministic_fallback"), ("2", "차", "deterministic_fallback")]
    assert of({"original_description": 8}) == [("1", "차량", "context_evidence"), ("2", "차", "deterministic_fallback")]
    assert of({"units": 1}) == [("1", "차", "context_evidence"), ("2", "차량", "context_evidence")]


def test_names_with_many_synonyms(spark):
    """Groups of over 10,000 candidates in all: names are unified as with the groups that occur."""
    cols = "row_no long, source_id string, column_name string, column_description string, table_name string, table_description string, data_type string"
    df = spark.createDataFrame([(i, f"r{i}", f"N{i}", d, "t", "", "") for i, d in enumerate(["차량번호", "차번호", "차량형태", "납부금", "납입금", None])], cols)
    syn = spark.createDataFrame(SYN, "group_id string, candidate string, candidate_order int")
    more = spark.range(10_002).select((F.col("id") / 2).cast("long").cast("string").alias("group_id"), F.concat(F.lit("항"), "id").alias("candidate"), (F.col("id") % 2).cast("int").alias("candidate_order"))
    g = spark.createDataFrame([], "source string, target string")
    of = lambda s: sorted(map(tuple, N.name_from_comments(df, g, s).collect()))
    few = of(syn)
    assert [r[1] for r in few] == ["차량번호", "차량번호", "차량형태", "납입금", "납입금", ""]
    assert of(syn.union(more)) == few


def test_review_loop(spark):
    """Only pending rows are proposed for, what is proposed for others is dropped, and it ends after its rounds."""
    df = spark.createDataFrame([("a", 10), ("b", 95), ("c", 60)], "source_id string, confidence int")
    stray = spark.createDataFrame([("b", 1)], "source_id string, confidence int")
    out = N.review_loop(df, lambda r: r.filter("confidence < 90").select("source_id"), lambda r: r.withColumn("confidence", F.col("confidence") + 40).unionByName(stray), 2)
    assert {tuple(r) for r in out.collect()} == {("a", 90), ("b", 95), ("c", 100)}


def test_accepting_works_names_out_once(spark):
    """Base, proposals and their issues all come from one written table: no task sorts pieces for each of them."""
    assert "Generate" not in queries.QUERIES["c06_c07_accept"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_no_table_of_rows_is_broadcast(spark):
    """Joins by source_id are merged, also of tables whose files are small enough for Spark to broadcast them."""
    df = spark.createDataFrame([(i, f"r{i}", "A_B", "T", "D", "X") for i in range(9)], "row_no long, source_id string, column_name string, table_name string, table_description string, data_type string")
    d = spark.createDataFrame([("A", "AA", "가", 3), ("B", "BB", "나", 2)], "abbreviation string, full_name string, korean_word string, occurrence_count int")
    p = df.select("source_id", F.expr("array(struct('A' as fragment, 'AA' as full, '가' as korean, 'mapping' as origin), struct('B' as fragment, 'BB' as full, '나' as korean, 'mapping' as origin)) as components"))
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    for frame in (P.name_from_dictionary(df, d), P._taken(core.cut(D.deterministic_results(df, d).select(*P.NAMED)), df, df, core.cut(p), d)):
        assert "BroadcastHashJoin [source_id" not in plan(frame) and "SortMergeJoin [source_id" in plan(frame)
    assert {r["korean_attribute_name"] for r in P.name_from_dictionary(df, d, p).collect()} == {"가나"}


def test_score_caps(spark):
    rubric = spark.createDataFrame([("x", 60.0), ("y", 40.0)], "id string, weight double")
    ratings = spark.createDataFrame([(r, d, 5.0) for r in "abc" for d in "xy"], "review string, dimension string, rating double")
    facts = spark.createDataFrame([("a", 0, 0, 9, 9), ("b", 1, 0, 9, 9), ("c", 1, 0, 8, 9)], "review string, critical int, failed_checks int, reviewed int, expected int")
    assert {r["review"]: (r["score"], r["passed"]) for r in audit.score_observations(ratings, rubric, facts).collect()} == {"a": (100.0, True), "b": (69.0, False), "c": (59.0, False)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    assert compare(spark, connection(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) == ""
