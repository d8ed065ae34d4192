"""Operators that SQL can't say, against plain Python."""

import json
import math
import random
import unicodedata
from itertools import groupby

from pyspark.sql import functions as F

from attrium.functions import text as X
from attrium.operators import dictionary as D, naming as N, proposals as P
from attrium.plans import more_queries as queries

SF = "/root/testdata/sf0.001"
DICT = [("DT", "DATE", "일자", 10), ("D", "DAY", "일", 3), ("T", "TYPE", "유형", 1), ("HMS", "TIME", "시각", 10), ("ORG", "ORGANIZATION", "기관", 10), ("OR", "ORDER", "주문", 4), ("CD", "CODE", "코드", 10), ("GCD", "GROUP CODE", "그룹코드", 2), ("RG", "RANGE", "범위", 1), ("C", "CITY", "시", 2), ("NO", "NUMBER", "번호", 5), ("AP", "APPLICATION", "적용", 10), ("AP", "APPROVAL", "승인", 1)]
SUFFIXES = ("CD", "NO", "DT", "HMS", "AMT", "CT", "YN", "NM", "SEQ", "SNO", "SEQNO", "FLGCD")
ENTRIES = "abbreviation string, full_name string, korean_word string, occurrence_count int"


def test_nfkc(spark):
    rows = [(t,) for t in ("ﬁ", "Å", "한글", "ㄱㅏ", "①②", "ｱ", "㎏", "é", "abc", "", None, "차량１２")]
    got = spark.createDataFrame(rows, "c string").select("c", X.nfkc(F.col("c")).alias("n")).collect()
    assert all(r["n"] == (None if r["c"] is None else unicodedata.normalize("NFKC", r["c"])) for r in got)
    out = queries.QUERIES["b04_nfkc"](spark, SF).collect()
    texts = {f"row-{r['doc_id']}": (r["text"] + (" " + r["source"] if r["doc_id"] % 5 == 0 else "") + ("/" + r["lang"] if r["doc_id"] % 10 == 0 else "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if None not in (r["text"], r["source"], r["lang"])}
    assert len(texts) > 150 and all(r["out"] == unicodedata.normalize("NFKC", texts[r["source_id"]]) for r in out if r["source_id"] in texts)


def every_way(token, senses):
    """All segmentations of a token, whatever their number: covered, score, components, ambiguity."""
    n = len(token)
    if not n:
        return [(0, 0.0, (), 0)]

    def steps(i):
        for j in range(i + 1, n + 1):
            part = token[i:j]
            if part in senses and (j - i > 1 or n == 1):
                full, korean, count, many = senses[part]
                size = j - i
                yield j, size, 10 * size + size * size + math.log1p(count) - 1 - 3 * many + 4 * (j == n and part in SUFFIXES), (part, full, korean, "mapping"), int(many)
        if token[i].isdigit():
            j = i + len(next("".join(g) for _, g in groupby(token[i:], str.isdigit)))
            yield j, j - i, 0.5 * (j - i), (token[i:j],) * 3 + ("numeric",), 0
        yield i + 1, 0, -20.0, (token[i], token[i], "", "inference"), 0

    def from_(i):
        if i == n:
            return [(0, 0.0, (), 0)]
        out = []
        for j, covered, score, part, many in steps(i):
            for c, s, parts, m in from_(j):
                if part[3] == "inference" and parts and parts[0][3] == "inference":
                    parts = ((part[0] + parts[0][0],) * 2 + ("", "inference"), *parts[1:])
                else:
                    parts = (part, *parts)
                out.append((c + covered, s + score, parts, m + many))
        return out

    best = {}
    for way in from_(0):
        if way[2] not in best or rank(way) < rank(best[way[2]]):
            best[way[2]] = way
    return sorted(best.values(), key=rank)


def rank(way):
    return -way[0], -round(way[1], 6), len(way[2]), way[2]


def test_segmentations_are_the_best_of_all(spark):
    """Ranks 1 to 8 with their scores, of names of one token and of two."""
    rng = random.Random(6)
    senses = {a: (f, k, n, a == "AP") for a, f, k, n in DICT if f != "APPROVAL"}
    tokens = ["ORGCD", "DTHMS", "AP12DT", "NO", "D", "XQ", "1234", "CDCD"] + ["".join(rng.choice(["ORG", "CD", "D", "T", "AP", "7", "42", "X", "GCD", "NO"]) for _ in range(rng.randrange(1, 4)))[:8] for _ in range(40)]
    names = [(t, "t", "") for t in tokens] + [(f"{a}_{b}", "t", "") for a, b in zip(tokens, reversed(tokens), strict=True)]
    d = spark.createDataFrame(DICT, ENTRIES)
    got = {}
    for r in D.segment_names(spark.createDataFrame(names, "column_name string, table_name string, table_description string"), d).orderBy("rank").collect():
        got.setdefault(r["column_name"], []).append((r["covered"], r["score"], list(zip(r["fragments"], r["full_names"], r["korean_words"], r["origins"], strict=True)), r["ambiguity"]))
    assert len(got) == len({n for n, *_ in names})
    for name, found in got.items():
        ways = [(0, 0.0, (), 0)]
        for token in name.split("_"):
            ways = sorted(((a[0] + b[0], a[1] + round(b[1], 6), a[2] + b[2], a[3] + b[3]) for a in ways for b in every_way(token, senses)[:8]), key=rank)[:8]
        assert [(c, s, parts, m) for c, s, parts, m in found] == [(w[0], round(w[1], 6), list(w[2]), w[3]) for w in ways], name


def test_requests_of_names(spark):
    """What a model is asked: the first candidates as they rank, all senses of their fragments and of the whole name."""
    d = spark.createDataFrame(DICT, ENTRIES)
    names = [("a", "AP12DT", "T", "d", "s"), ("b", "ORGCD", None, None, None), ("c", "__", "T", "d", "s"), ("e", None, "T", "d", "s"), ("f", "APPR", "승인", "d", "s")]
    df = spark.createDataFrame(names, "source_id string, column_name string, table_name string, table_description string, data_type string")
    segments = D.segment_names(df, d)
    by = {}
    for r in segments.orderBy("rank").collect():
        by.setdefault(r["column_name"], []).append(r)
    senses = {}
    for a, f, k, n in sorted(DICT, key=lambda e: (-e[3], e[1], e[2])):
        senses.setdefault(a, []).append((f, k, n))
    asked = {r["source_id"]: json.loads(r["request"]) for r in P.encode_requests(df, segments, d).collect()}
    assert set(asked) == set("abcef")
    for i, name, *_ in names:
        few = by.get(name or "", [])[:4]
        request = asked[i]
        assert request["source"]["column_name"] == (name or "") and len(request["candidates"]) == len(few)
        for got, r in zip(request["candidates"], few, strict=True):
            assert [(c["source_fragment"], c["full_name"], c["korean_word"], c["origin"]) for c in got["components"]] == list(zip(r["fragments"], r["full_names"], r["korean_words"], r["origins"], strict=True))
            assert got["unresolved_fragments"] == [f for f, o in zip(r["fragments"], r["origins"], strict=True) if o == "inference"]
            assert got["score"] == r["score"] and got["coverage"] == round(r["covered"] / len(name), 6)
        fragments = {f for r in few for f in r["fragments"]} | ({name} if few else set())
        want = {f: senses[f] for f in fragments if f in senses}
        assert {k: [(s["full_name"], s["korean_word"], s["occurrence_count"]) for s in v] for k, v in request["mapping_options"].items()} == want
    found = {r["column_name"]: r for r in N.resolution_requests(segments, d).collect()}
    for name, rows in by.items():
        assert found[name]["candidates"] == ["|".join(r["fragments"]) for r in rows[:4]]
        fragments = {f for r in rows for f in r["fragments"]} | {name}
        assert (found[name]["options"] or {}) == {f: sorted({f"{a}→{b}" for a, b, _ in senses[f]}) for f in fragments if f in senses}
