"""Hard negatives against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from attrium.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives=5, wanted=3, low=50, high=95):
    ok = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if None not in (i, v, g) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, g in ok:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, h) for j, w, h in ok if j != i)
            for s, j, _ in [x for x in scored if x[2] == g][:positives]:
                inside = [x for x in scored if x[2] != g and low * -s <= 100 * -x[0] <= high * -s]
                out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside[:wanted])]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("blocks", [(2048, 8192), (4, 16)])
@pytest.mark.parametrize("scale", [1.0, 0.01])
def test_against_plain_python(spark, blocks, scale):
    """Small components give many ties and many scores of zero."""
    rng = random.Random(7)
    rows = [(i, [scale * rng.gauss(0, 1) for _ in range(3)], rng.choice([1, 1, 1, 1, 2, 3])) for i in range(-60, 200)]
    rows += [(1000, [1.0, 1.0, 1.0], 9), (1001, [0.0, 0.0, 0.0], 1), (1005, [0.0, 0.0, 0.0], 2)]
    want = brute(rows, 5)
    assert mined(spark, rows, 5, anchor_block=blocks[0], data_block=blocks[1]) == want and len(want) > 100


def test_windows_at_zero_and_below(spark):
    rows = [(0, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [-1.0, 0.0], 1), *[(i, [0.0, 1.0], 2) for i in (1, 2, 3, 4, 7, 8)], (9, [-0.6, 0.0], 2)]
    assert mined(spark, rows, 10) == brute(rows, 10) == [(0, 5, k, n, 0, 0) for k, n in ((1, 1), (2, 2), (3, 3))]


def test_keys_sort_as_they_should():
    rng = random.Random(1)
    ends = [-(2**63) + 1, -1, 0, 1, 2**63 - 1]
    rows = [(rng.choice(ends), rng.choice(ends), rng.choice(ends)) for _ in range(300)]
    assert sorted(rows, key=lambda r: negatives.key(*r)) == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    assert all(negatives.unpacked(negatives.key(*r)) == r for r in rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (5, [1.0, 1.5], 1), (6, [1.0], 2), (7, [0.5, 1.0], 2), (8, [], 2), (7, [0.5, 1.0], 2)]
    assert mined(spark, rows, 10) == brute(rows[:-1], 10) == [(0, 5, 1, 7, 65536 * 4, 65536 * 5 // 2)]
    assert mined(spark, rows[:1], 10) == mined(spark, [], 10) == []
    extra = spark.createDataFrame([(*r, "k", {"a": 1}, 2) for r in rows], SCHEMA + ", key string, x map<string,int>, anchor_id int")
    assert negatives.hard_negatives(extra, F.col("vec_id") % 10 == 0, F.col("label")).count() == 1
