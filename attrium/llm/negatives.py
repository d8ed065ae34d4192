"""Hard negatives by a secondary sort.

First the best rows of each anchor's own label are found, label by label: they are its positives, and their scores
open windows. Then anchors meet all rows, in blocks; of each pair of blocks come the positives and, for each window,
the best rows of other labels in it. Their (anchor, descending score, id) is packed into a key whose bytes sort
that way; rows are dealt by anchor and sorted by key where they arrive, and a single pass over them opens a window
for each positive and emits the negatives that fall into it. Nothing of an anchor is held but its open windows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .knn import LEAST, MOST, _best, _scores, _vectors
from .store import stored

FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
KEYED = "anchor_id long, key binary, positive boolean"
TOP = 1 << 63


def key(anchor: int, score: int, vec_id: int) -> bytes:
    """Sorts by anchor, then by descending score, then by id."""
    return struct.pack(">QQQ", anchor + TOP, TOP - 1 - score, vec_id + TOP)


def unpacked(k: bytes) -> tuple[int, int, int]:
    anchor, score, vec_id = struct.unpack(">QQQ", k)
    return anchor - TOP, TOP - 1 - score, vec_id - TOP


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest score of a negative, for low and high in hundredths of the positive's."""
    return -(-low * score // 100), high * score // 100


def _prepared(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id, label, q, x (integers, packed) of the rows that take part, and the number of components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, good = _vectors(b["v"], dim)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "q": b["q"], "x": x})[good]

    ints = stored(rows.mapInPandas(packed, "vec_id long, label long, q boolean, x binary"), "vectors")
    if not ints.groupBy("vec_id").count().filter("count > 1").isEmpty():
        least = F.min(F.struct("x", "label")).alias("r")
        ints = stored(ints.groupBy("vec_id").agg(F.max("q").alias("q"), least).select("vec_id", "r.label", "q", "r.x"), "vectors")
    return ints, dim


def _dealt(df: DataFrame, name: str, rows: int, by: str | None = None) -> DataFrame:
    """df with column `name`: a block of about that many rows, of each value of `by` apart; and n_<name>, their number."""
    sizes = df.groupBy(*([by] if by else [])).count()
    sizes = sizes.select(*([by] if by else []), F.ceil(F.col("count") / rows).cast("int").alias(f"n_{name}"))
    found = df.join(sizes, by) if by else df.crossJoin(F.broadcast(sizes))  # without `by` one row
    return found.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(f"n_{name}")).cast("int"))


def _all(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _positives(ints: DataFrame, k: int, dim: int, anchor_block: int, data_block: int) -> DataFrame:
    """anchor_id and windows: the ids and scores of its k best other rows of the same label, best first. Only rows of one
    label meet; of a label that many rows have, blocks of anchors meet blocks of rows."""
    asked = _dealt(ints.filter("q"), "b", anchor_block, "label")
    rows = _dealt(ints, "h", data_block, "label")
    left = asked.join(rows.select("label", "n_h").distinct(), "label").select("label", "b", _all("n_h").alias("h"), F.col("vec_id").alias("anchor_id"), "x")
    right = rows.join(asked.select("label", "n_b").distinct(), "label").select("label", _all("n_b").alias("b"), "h", "vec_id", "x")

    def best(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        ids, other, found = q["anchor_id"].to_numpy(), s["vec_id"].to_numpy(), []
        for i in range(0, len(q) if len(s) else 0, 256):
            found.append(_best(other, _scores(q["x"][i : i + 256], s["x"], dim), ids[i : i + 256], k))
        if not found:
            return pd.DataFrame({"anchor_id": [], "key": []})
        top = pd.concat(found)
        return pd.DataFrame({"anchor_id": top["query_id"], "key": [key(*r) for r in zip(top["query_id"], top["score"], top["vec_id"], strict=True)]})

    found = left.toDF(*left.columns).groupBy("label", "b", "h").cogroup(right.groupBy("label", "b", "h")).applyInPandas(best, "anchor_id long, key binary")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, scores = None, [], []
        for b in batches:
            out = []
            for k_ in b.column("key").to_pylist():
                anchor, score, vec_id = unpacked(k_)
                if anchor != now:
                    out.append((now, ids, scores))
                    now, ids, scores = anchor, [], []
                if len(ids) < k:
                    ids.append(vec_id)
                    scores.append(score)
            yield _windows(out)
        yield _windows([(now, ids, scores)])

    return stored(found.repartition("anchor_id").sortWithinPartitions("key").mapInArrow(first, "anchor_id long, ids array<long>, scores array<long>"), "windows")


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*(r for r in rows if r[0] is not None), strict=True)) or [[], [], []]
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor_id", "ids", "scores"])


def _candidates(ints: DataFrame, windows: DataFrame, k: int, negatives: int, low: int, high: int, dim: int, anchor_block: int, data_block: int) -> DataFrame:
    """The keys of each anchor's positives, and from each pair of blocks the `negatives` best rows of another label in
    each of its windows: so many of a pair at most, whatever the labels are."""
    asked = _dealt(ints.filter("q").select(F.col("vec_id").alias("anchor_id"), "vec_id", "label", "x").join(windows, "anchor_id"), "b", anchor_block)
    rows = _dealt(ints.select("vec_id", "label", "x"), "h", data_block)
    left = asked.crossJoin(F.broadcast(rows.select("n_h").limit(1))).select("b", _all("n_h").alias("h"), "anchor_id", "label", "x", "scores")  # one row
    right = rows.crossJoin(F.broadcast(asked.select("n_b").limit(1))).select(_all("n_b").alias("b"), "h", "vec_id", "label", "x")  # one row

    def within(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int, int]] = set()
        s = s.sort_values("vec_id", ignore_index=True)
        ids = s["vec_id"].to_numpy()
        for i in range(0, len(q) if len(s) else 0, 128):
            part = q[i : i + 128]
            scores = _scores(part["x"], s["x"], dim)
            scores[part["label"].to_numpy()[:, None] == s["label"].to_numpy()[None, :]] = LEAST
            of = part["scores"].tolist()
            for w in range(k):
                spans = [window(int(x[w]), low, high) if len(x) > w else (1, 0) for x in of]
                lo = np.array([max(LEAST + 1, a) if a <= b else MOST for a, b in spans], np.int64)
                hi = np.array([max(LEAST + 1, min(MOST, b)) if a <= b else LEAST + 1 for a, b in spans], np.int64)
                inside = np.where((scores >= lo[:, None]) & (scores <= hi[:, None]), scores, LEAST)
                least = np.partition(inside, -negatives, axis=1)[:, -negatives] if inside.shape[1] > negatives else inside.min(axis=1)
                a, at = np.nonzero((inside >= least[:, None]) & (inside != LEAST))
                order = np.lexsort((at, -inside[a, at], a))  # rows are in order of their ids
                a, at = a[order], at[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                names = part["anchor_id"].to_numpy()
                found.update(zip(*(x[place < negatives].tolist() for x in (names[a], scores[a, at], ids[at])), strict=True))
        return pd.DataFrame([(r[0], key(*r), False) for r in sorted(found)], columns=["anchor_id", "key", "positive"])

    def positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(a, key(a, int(s), int(v)), True) for a, ids, scores in zip(b["anchor_id"].tolist(), b["ids"], b["scores"], strict=True) for v, s in zip(ids, scores, strict=True)]
            yield pd.DataFrame(found, columns=["anchor_id", "key", "positive"])

    found = left.toDF(*left.columns).groupBy("b", "h").cogroup(right.groupBy("b", "h")).applyInPandas(within, KEYED)
    return found.unionByName(windows.mapInPandas(positives, KEYED))


def _mined(negatives: int, low: int, high: int):
    """One pass over rows in order of their keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        open_: list[list] = []  # id, score, window, negatives so far
        zeros: list[tuple[int, int]] = []  # negatives with score 0, which a positive with score 0 may follow
        for b in batches:
            out = []
            for k, positive in zip(b.column("key").to_pylist(), b.column("positive").to_pylist(), strict=True):
                anchor, score, vec_id = unpacked(k)
                if anchor != now:
                    now, open_, zeros = anchor, [], []
                if positive:
                    open_.append(opened := [vec_id, score, *window(score, low, high), 0])
                    meet = [(x, opened) for x in zeros] if score == 0 else []
                else:
                    if score == 0 and len(zeros) < negatives:
                        zeros.append((vec_id, score))
                    meet = [((vec_id, score), x) for x in open_]
                for (other, s), x in meet:
                    if x[2] <= s <= x[3] and x[4] < negatives:
                        x[4] += 1
                        out.append((anchor, x[0], x[4], other, x[1], s))
                # scores fall: a window that lies above them, or is full, is done with
                open_ = [x for x in open_ if x[2] <= score and x[4] < negatives]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])

    return each


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    anchor_block: int = 2048,
    data_block: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. For each row for which is_anchor holds
    its best rows of the same label (positives), and for each of these the best rows of another label whose score lies
    between low and high hundredths of the positive's (negatives); all, if there are fewer.

    Scores are inner products of floor(256 x), higher ones first, ties by smaller id. Rows with a null id, label or
    vector, or a component that is null or not finite, take no part; shorter vectors are padded with zeros. A repeated id
    counts once, with its smallest vector. Scores beyond 64 bits are held to their ends. A positive with a negative score has no
    window. No anchor, no row."""
    ints, dim = _prepared(vectors, is_anchor, label, id_col, vector_col)
    windows = _positives(ints, positives, dim, anchor_block, data_block)
    keyed = _candidates(ints, windows, positives, negatives, low, high, dim, anchor_block, data_block)
    return keyed.repartition("anchor_id").sortWithinPartitions("key").mapInArrow(_mined(negatives, low, high), FOUND)
