"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from attrium.llm import importance

RNG = random.Random(5)
VOCABULARY = ["the", "of", "Zebra", "naïve", "汉字", "x9", "w" * 300, "q" * 70] + [f"w{i}" for i in range(80)]
TEXTS = [" ".join(RNG.choices(VOCABULARY, weights=[40, 30, 9, 9, 9, 9, 3, 3] + [1] * 80, k=RNG.randrange(60))) + RNG.choice(["", "!", "\n\n..."]) for _ in range(60)] + [None, "", "..., --", "one", "A" * 5000, "  a\x00b\x7fc_d`e{f  "]
TARGET = [(i, " ".join(RNG.choices(VOCABULARY[:20], k=30))) for i in range(9)] + [(None, None), (10, "")]


def features(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def brute(docs, target, percent=25):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, (x for _, x in docs)), (t, (x for _, x in target))):
        for text in texts:
            for f in features(text):
                counts[f] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize(("most", "run"), [(importance.HEAD_WORDS, importance.SLICE), (3, 16), (0, 1)])
def test_against_plain_python(spark, monkeypatch, most, run):
    """With a head of any size, and texts cut into runs."""
    for name, value in (("HEAD_WORDS", most), ("HEAD_PAIRS", most), ("SLICE", run), ("COUNTERS", max(4, most))):
        monkeypatch.setattr(importance, name, value)
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (None, TEXTS[0]), (-4, TEXTS[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = importance.importance_resample(df, spark.createDataFrame(TARGET, "item_id long, text string"))
    assert sorted((list(r) for r in found.collect()), key=repr) == brute(docs, TARGET)
    ids = {r[0] for r in brute(docs, TARGET) if r[4]}
    assert {r["doc_id"] for r in importance.drawn(df, found).collect()} == ids


def test_head_has_what_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(importance, "COUNTERS", 8)
    monkeypatch.setattr(importance, "HEAD_WORDS", 4)
    rows = [(f"often w{i} often again v{i} u{i}",) for i in range(300)]
    known = importance.head(spark.createDataFrame(rows, "text string").repartition(5))
    assert b"often" in known.words
    assert known.words[b"often"][1:] == (crc32(b"often"), crc32(b"often "))


def test_edges(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(TARGET, "item_id long, text string")
    assert importance.importance_resample(docs, target).count() == 0
    same = spark.createDataFrame([(1, "a b " * 30)] * 8, "doc_id long, text string")
    found = importance.importance_resample(same, target.limit(0))
    assert sorted(r["rank"] or 0 for r in found.collect()) == [0] * 6 + [1, 2]
    extra = spark.createDataFrame([(1, "a b", 5, {"k": 1}, "s")], "doc_id long, text string, weight int, n_features map<string,int>, score string")
    assert importance.weigh(extra, target, prefix="_w_").columns == [*extra.columns, "_w_n_features", "_w_weight"]
    assert importance.importance_resample(extra, target).select(F.col("n_features")).first()[0] == 3
