"""Exact top-k by inner product: a Voronoi join.

Rows belong to the cell of the pivot whose direction is nearest. About a pivot's direction u a row falls into
a projection a and a residual b, and for a query q follows q.s <= (q.u) a + |q - (q.u)u| b. Summaries (the
ranges of a and b in each ring of a cell) thus bound every score that the ring can give. Queries are grouped
into blocks of neighbouring cells; a block first meets a few rows of its own cells, which gives each query a
score that its k-th best cannot fall below, and then only the rings that may reach it are replicated to the
block. Blocks of queries meet chunks of rows, and the best of each pair are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import stored

SMALL = 1 << 26  # rows with components beyond it are wide: 8 bytes a component, in a cell of their own (-1)
SEED = 1024  # rows of a cell, about, that its own queries meet first
ANGLES, NORMS = 16, 32  # rings of a cell: sixteenths of the cosine, powers of two of the norm
SENT = 200_000  # needed rings (about 30 bytes each) that are broadcast; more are joined by chunk
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _vectors(values: pd.Series, dim: int) -> tuple[list[bytes], np.ndarray]:
    """Integer vectors floor(256 x), padded with zeros to dim: four bytes a component, wide ones as the
    floating-point numbers that they are (a floor is one without loss). Then which rows take part."""
    out, good = [], np.zeros(len(values), bool)
    for i, v in enumerate(values):
        row = np.zeros(dim)
        if v is not None:
            x = np.array([np.nan if e is None else e for e in v] if getattr(v, "dtype", None) == object else v, np.float64)
            if good_row := bool(np.isfinite(x).all()):
                with np.errstate(over="ignore"):
                    row[: len(x)] = np.floor(256 * x)
                # what 256 x takes beyond floating point is held to its end
                np.clip(row, np.finfo(float).min, np.finfo(float).max, out=row)
            good[i] = good_row
        out.append((row.astype(np.int32) if np.abs(row).max(initial=0) <= SMALL else row).tobytes())
    return out, good


def _unpack(packed: pd.Series, dim: int) -> np.ndarray:
    """Small vectors as integers; wide ones as zeros."""
    none = bytes(4 * dim)
    return np.frombuffer(b"".join(x if len(x) == 4 * dim else none for x in packed), np.int32).reshape(len(packed), dim).astype(np.int64)


def _whole(x: bytes, dim: int) -> list[int]:
    return [int(e) for e in np.frombuffer(x, np.int32 if len(x) == 4 * dim else np.float64)]


def _wide(packed: pd.Series, dim: int) -> np.ndarray:
    return np.flatnonzero([len(x) != 4 * dim for x in packed])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T in integers; by floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _scores(q: pd.Series, s: pd.Series, dim: int) -> np.ndarray:
    """All scores of queries and rows. Pairs with a wide vector are summed in integers of any size, and held
    to the ends of 64 bits."""
    out = _product(_unpack(q, dim), _unpack(s, dim))
    wide_q, wide_s = _wide(q, dim), _wide(s, dim)
    if len(wide_q) or len(wide_s):
        left, right = [_whole(x, dim) for x in q], [_whole(x, dim) for x in s]
        for i, js in [*((i, range(len(right))) for i in wide_q.tolist()), *((i, wide_s.tolist()) for i in range(len(left)))]:
            for j in js:
                out[i, j] = max(LEAST + 1, min(MOST, sum(x * y for x, y in zip(left[i], right[j], strict=True))))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Of each query (a row of scores) its k best other rows; ties to the smaller id."""
    scores = np.where(queries[:, None] == ids[None, :], LEAST, scores)
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else scores.min(axis=1)
    q, s = np.nonzero(scores >= least[:, None])
    found = pd.DataFrame({"query_id": queries[q], "vec_id": ids[s], "score": scores[q, s]})
    found = found[found["score"] != LEAST].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(k)


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    """n directions of rows, each as far as can be from those before it; in an order in which neighbours
    follow each other."""
    size = np.sqrt((rows**2).sum(axis=1))
    rows = np.unique(rows[size > 0] / size[size > 0, None], axis=0)
    if not len(rows):
        return np.eye(1, rows.shape[1])
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(n, len(rows)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    left, order = rows[chosen], [0]
    free = np.ones(len(left), bool)
    free[0] = False
    while free.any():
        order.append(int(np.argmax(np.where(free, left @ left[order[-1]], -np.inf))))
        free[order[-1]] = False
    return left[order]


@dataclass(frozen=True)
class Plan:
    """asked: b (block), query_id, qx. sent: b, h (chunk), vec_id, x, the rows that each block needs."""

    asked: DataFrame
    sent: DataFrame
    dim: int
    blocks: int
    chunks: int


def plan(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, query_block: int = 2048, data_block: int = 8192) -> Plan | None:
    """Which rows go to which queries; None without rows. pivots: by default one for each 4096 rows, 8 to 512."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("vec_id is not null and v is not null")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def packed(batches):
        for b in batches:
            x, good = _vectors(b["v"], dim)
            yield pd.DataFrame({"vec_id": b["vec_id"], "q": b["q"], "x": x})[good]

    ints = stored(rows.mapInPandas(packed, "vec_id long, q boolean, x binary"), "vectors")
    if not ints.groupBy("vec_id").count().filter("count > 1").isEmpty():
        ints = stored(ints.groupBy("vec_id").agg(F.max("q").alias("q"), F.min("x").alias("x")), "vectors")
    n = ints.count()
    if not n or not dim:
        return None
    pivots = pivots or min(512, max(8, n // 4096))
    drawn = ints.filter(F.length("x") == 4 * dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(8 * pivots).select("x").collect()  # at most 8 x 512 rows
    centres = _spread(_unpack(pd.Series([r["x"] for r in drawn], dtype=object), dim).astype(float), pivots)

    def grouped(batches):
        for b in batches:
            if not len(b):
                continue
            x = _unpack(b["x"], dim).astype(np.float64)
            near = x @ centres.T
            g = near.argmax(axis=1)
            along, norm = near[np.arange(len(x)), g], np.sqrt((x**2).sum(axis=1))
            angle = np.clip(np.floor((along / np.where(norm > 0, norm, 1) + 1) * ANGLES / 2), 0, ANGLES - 1)
            ring = angle + ANGLES * np.clip(np.floor(np.log2(np.maximum(norm, 1))), 0, NORMS - 1)
            g[_wide(b["x"], dim)] = -1
            yield b.assign(g=g.astype(np.int32), ring=ring.astype(np.int32), along=along, off=np.sqrt(np.maximum(0, norm**2 - along**2)))

    cells = stored(ints.mapInPandas(grouped, "vec_id long, q boolean, x binary, g int, ring int, along double, off double"), "cells")
    # summaries: at most 513 x 512 rings, and a row for each pivot
    rings = cells.groupBy("g", "ring").agg(F.min("along").alias("lo"), F.max("along").alias("hi"), F.max("off").alias("off")).toPandas()
    sizes = sorted((r["g"], r["n"], r["nq"]) for r in cells.groupBy("g").agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).collect())
    first, blocks, filled, deal = 0, 0, 0, []
    for g, size, asking in sizes:  # neighbouring cells share a block; a cell with more queries has several
        if asking and (filled + asking > query_block or not blocks):
            first, blocks, filled = blocks, blocks + -(-asking // query_block), 0
        filled += asking
        deal.append((g, first, max(1, -(-asking // query_block)), max(1, size // SEED)))
        if asking > query_block:
            filled = query_block
    if not blocks:
        return None
    chunks = max(1, -(-n // data_block))
    by_cell = F.broadcast(vectors.sparkSession.createDataFrame(deal, "g int, first int, parts int, shares int"))
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int").alias("h")
    asked = stored(cells.filter("q").join(by_cell, "g").select((F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("parts"))).cast("int").alias("b"), F.col("vec_id").alias("query_id"), F.col("x").alias("qx")), "asked")
    seeds = cells.join(by_cell, "g").filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("shares")) == 0)
    seeds = seeds.select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("b"), "vec_id", "x")

    def needs(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        """The rings that may hold one of the k best of a query of this block."""
        need = np.zeros(len(rings), bool)
        ring_g, lo, hi, off = (rings[c].to_numpy() for c in ("g", "lo", "hi", "off"))
        for i in range(0, len(q), 128):
            part = q[i : i + 128]
            x = _unpack(part["qx"], dim).astype(np.float64)
            ids = part["query_id"].to_numpy()
            scores = np.where(ids[:, None] == s["vec_id"].to_numpy()[None, :], LEAST, _scores(part["qx"], s["x"], dim))
            floor = np.partition(scores, -k, axis=1)[:, -k].astype(np.float64) if scores.shape[1] >= k else np.full(len(x), float(LEAST))
            dots, norm = x @ centres.T, np.sqrt((x**2).sum(axis=1))
            side = np.sqrt(np.maximum(0, norm[:, None] ** 2 - dots**2))
            top = np.maximum(dots[:, ring_g] * lo, dots[:, ring_g] * hi) + side[:, ring_g] * off
            slack = 1e-6 + 1e-9 * norm[:, None] * np.maximum(np.maximum(np.abs(lo), np.abs(hi)), off)
            need |= (top + slack >= floor[:, None]).any(axis=0) | (ring_g < 0)
            if len(_wide(part["qx"], dim)):
                need[:] = True
        return pd.DataFrame({"b": np.int32(q["b"].iloc[0]) if len(q) else np.int32(0), "g": ring_g[need & (len(q) > 0)], "ring": rings["ring"].to_numpy()[need & (len(q) > 0)]})

    needed = stored(asked.groupBy("b").cogroup(seeds.groupBy("b")).applyInPandas(needs, "b int, g int, ring int"), "needed")
    rows = cells.select("vec_id", "x", "g", "ring", chunk)
    if needed.count() <= SENT:
        sent = rows.join(F.broadcast(needed), ["g", "ring"])
    else:  # a cell that very many rows are in is dealt by chunk
        sent = rows.join(needed.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("h")), ["g", "ring", "h"])
    return Plan(asked, sent.select("b", "h", "vec_id", "x"), dim, blocks, chunks)


def voronoi_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, query_block: int = 2048, data_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, its k best other rows.

    Vectors that are null or hold null or non-finite components, and rows without id, take no part; shorter
    vectors are padded with zeros. Scores are exact sums of integers; those beyond 64 bits (and 256 x beyond
    floating point) are held to their ends, with ties to the smaller id. A repeated id counts once, with its smallest vector. Fewer than k
    other rows: all of them. No query or no data: no row."""
    made = plan(vectors, is_query, k, id_col, vector_col, pivots, query_block, data_block)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = made.dim
    left = made.asked.select("b", F.explode(F.sequence(F.lit(0), F.lit(made.chunks - 1))).alias("h"), "query_id", "qx")

    def solve(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        parts = [_best(s["vec_id"].to_numpy(), _scores(q["qx"][i : i + 256], s["x"], dim), q["query_id"].to_numpy()[i : i + 256], k) for i in range(0, len(q), 256) if len(s)]
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = left.groupBy("b", "h").cogroup(made.sent.groupBy("b", "h")).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
