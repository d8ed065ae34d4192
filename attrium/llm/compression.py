"""Quality rules on compressibility: zstandard ratios of whole texts and of fixed chunks, by length.

What ratio is usual depends on the length: short texts hardly compress, long ones always do. So the limits are
bands along the length, set from the ratios of texts that are labelled clean, and read between two bands on a
straight line over the logarithm of the length. A chunk is held to the limits of its own length.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .store import append_columns, stored

#: White space between words, and the characters counted as symbols.
WORD_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Least and greatest compressed / raw size that is usual for texts of about so many bytes (UTF-8)."""

    size: float
    low: float
    high: float


#: Limits for a table without labels: those that calibrate() gives for all labels of the sf0.1 test tables.
BANDS = (
    Band(96, 0.73, 1.26),
    Band(287, 0.57, 0.76),
    Band(445, 0.57, 0.72),
    Band(631, 0.54, 0.70),
    Band(869, 0.50, 0.62),
    Band(1214, 0.48, 0.58),
    Band(1731, 0.47, 0.55),
    Band(2452, 0.46, 0.52),
    Band(3447, 0.44, 0.50),
    Band(4820, 0.43, 0.48),
    Band(6868, 0.42, 0.47),
    Band(11610, 0.39, 0.45),
)
CHUNK = 1024
BAD_CHUNKS = 0.25  # share of a text's chunks that may lie outside the limits


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: of the empty one)."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes split at exactly the six ASCII space characters
    n = len(words)
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(WORD_SPACE))
            seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(often := Counter(windows)) < len(windows):
            end = 0  # words before it are counted
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeat += i + 5 - max(i, end)
                    end = i + 5
    return n, chars, symbols, dup, repeat


def base_failed(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


def ratio(raw: bytes, level: int = 3) -> float:
    """Compressed / raw size; 0 for nothing."""
    return len(_compressor(level).compress(raw)) / len(raw) if raw else 0.0


def chunks(raw: bytes, size: int = CHUNK) -> list[bytes]:
    """Chunks of that size; the last one joins its neighbour if it is under half of it."""
    cuts = list(range(0, len(raw), size))
    if len(cuts) > 1 and len(raw) - cuts[-1] < size // 2:
        cuts.pop()
    return [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


@cache
def _lines(bands: tuple[Band, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.log2([b.size for b in bands]), np.array([b.low for b in bands]), np.array([b.high for b in bands])


def usual(ratios: np.ndarray, sizes: np.ndarray, bands: tuple[Band, ...]) -> np.ndarray:
    """-1, 0 or 1 for each ratio of texts of these sizes: below, within or above the limits. Beyond the first
    and last band their limits hold."""
    at, low, high = _lines(bands)
    x = np.log2(sizes)
    return (ratios > np.interp(x, at, high)).astype(int) - (ratios < np.interp(x, at, low))


def verdict(raw: bytes, bands: tuple[Band, ...] = BANDS) -> tuple[float, float, str]:
    """Whole ratio, share of chunks outside the limits, reason ('' if kept)."""
    if not raw:
        return 0.0, 0.0, ""
    parts = chunks(raw)
    whole = ratio(raw)
    found = np.array([whole, *map(ratio, parts)] if len(parts) > 1 else [whole])
    how = usual(found, np.array([len(raw), *map(len, parts)] if len(parts) > 1 else [len(raw)]), bands)
    bad = float(np.mean(how[1:] != 0)) if len(parts) > 1 else float(how[0] != 0)
    return whole, bad, "repetitive" if how[0] < 0 else "incompressible" if how[0] > 0 else "chunks" if bad > BAD_CHUNKS else ""


def bands_of(sizes: np.ndarray, found: np.ndarray, band_rows: int = 30, tail: float = 0.005, margin: float = 1.35) -> tuple[Band, ...]:
    """Bands from sizes and ratios of clean texts: half powers of two, joined upwards until each has band_rows
    texts. The limits lie margin times as far from the usual ratio as the tail quantiles of its band."""
    x = np.log2(sizes)
    groups, open_rows = [], np.array([], int)
    for half in np.unique(np.floor(2 * x)):
        open_rows = np.append(open_rows, np.flatnonzero(np.floor(2 * x) == half))
        if len(open_rows) >= band_rows:
            groups.append(open_rows)
            open_rows = np.array([], int)
    if groups:
        groups[-1] = np.append(groups[-1], open_rows)
    if not groups:
        return ()
    at, middle = np.array([x[g].mean() for g in groups]), np.array([np.median(found[g]) for g in groups])
    off = found - np.interp(x, at, middle)
    return tuple(Band(float(2**a), float(m + margin * np.quantile(off[g], tail)), float(m + margin * np.quantile(off[g], 1 - tail))) for a, m, g in zip(at, middle, groups, strict=True))


#: Steps of a ratio (2**-20) in which quantiles are told apart, and of a logarithm's sum, which so is the same in any order.
STEPS, FINE = 1 << 20, 1 << 10
MEASURED = pa.schema([("size", pa.int64()), ("ratio", pa.float64()), ("x", pa.float64()), ("half", pa.int64())])


def _measured(texts: list) -> list[list]:
    """Of each text its size, ratio, and the logarithm of its size, also in halves; size 0 if the base rules reject it."""
    raw = [b"" if base_failed(base_counts(t)) else (t or "").encode("utf-8", "replace") for t in texts]
    x = np.log2([max(1, len(r)) for r in raw])
    return [list(map(len, raw)), list(map(ratio, raw)), x.tolist(), np.floor(2 * x).astype(np.int64).tolist()]


def _quantiles(rows: DataFrame, value: Column, wanted: list[float]) -> dict[int, list[float]]:
    """Of each g in rows the quantiles of value over all rows, linear between neighbours: counts in coarse steps tell
    which of these the neighbours are in, counts in fine steps the neighbours. Only counts come to the driver."""
    v = F.floor(value * STEPS).cast("long")
    rows = rows.select("g", F.floor(v / FINE).alias("hi"), F.pmod(v, F.lit(FINE)).alias("lo"))
    coarse: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("g", "hi").agg(F.count("*").alias("n")).collect():  # a few thousand of a band
        coarse.setdefault(r["g"], []).append((r["hi"], r["n"]))
    places: dict[tuple[int, int], list[tuple[int, int]]] = {}  # of a band and rank: coarse step and rank in it
    for g, found in coarse.items():
        found.sort()
        ends = np.cumsum([n for _, n in found])
        for q in wanted:
            at = q * (int(ends[-1]) - 1)
            for rank in (int(at), min(int(at) + 1, int(ends[-1]) - 1)):
                k = int(np.searchsorted(ends, rank, "right"))
                places[g, rank] = (found[k][0], rank - int(ends[k]) + found[k][1])
    if not places:
        return {}
    steps = rows.sparkSession.createDataFrame(sorted({(g, hi) for (g, _), (hi, _) in places.items()}), "g int, hi long")
    fine: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in rows.join(F.broadcast(steps), ["g", "hi"]).groupBy("g", "hi", "lo").agg(F.count("*").alias("n")).collect():  # FINE of a step
        fine.setdefault((r["g"], r["hi"]), []).append((r["lo"], r["n"]))

    def value_at(g: int, rank: int) -> float:
        hi, within = places[g, rank]
        found = sorted(fine[g, hi])
        k = int(np.searchsorted(np.cumsum([n for _, n in found]), within, "right"))
        return (hi * FINE + found[k][0]) / STEPS

    out = {}
    for g, found in coarse.items():
        last = sum(n for _, n in found) - 1
        pairs = [(q * last - int(q * last), value_at(g, int(q * last)), value_at(g, min(int(q * last) + 1, last))) for q in wanted]
        out[g] = [low + part * (high - low) for part, low, high in pairs]
    return out


def calibrate(docs: DataFrame, clean: DataFrame, id_col: str = "doc_id", text_col: str = "text", band_rows: int = 30, tail: float = 0.005, margin: float = 1.35) -> tuple[Band, ...]:
    """Bands as of bands_of from all documents whose ids are in clean, but for quantiles in steps of 2**-20. Those that fail
    the base rules don't count. BANDS if there are too few. No text is shuffled."""
    ids = clean.select(F.col(id_col).cast("long").alias("_id")).filter("_id is not null").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = append_columns(texts, ("_text",), _measured, MEASURED).drop("_text").filter("size > 0")
    rows = stored(rows.join(ids, "_id", "left_semi").drop("_id"), "ratios")
    halves = sorted(map(tuple, rows.groupBy("half").agg(F.count("*"), F.sum(F.round(F.col("x") * (1 << 24)).cast("long"))).collect()))  # two for each power of two
    groups, n, total = [], 0, 0  # the last half of a group, its rows and the sum of their logarithms
    for half, more, x in halves:
        n, total = n + more, total + x
        if n >= band_rows:
            groups.append([half, n, total])
            n = total = 0
    if not groups:
        return BANDS
    groups[-1] = [halves[-1][0], groups[-1][1] + n, groups[-1][2] + total]
    at = [total / n / (1 << 24) for _, n, total in groups]
    of = F.lit(len(groups) - 1)
    for g in range(len(groups) - 2, -1, -1):
        of = F.when(F.col("half") <= groups[g][0], g).otherwise(of)
    rows = rows.select("x", "ratio", of.cast("int").alias("g"))
    middle = [m for _, (m,) in sorted(_quantiles(rows, F.col("ratio"), [0.5]).items())]
    usual_ = F.lit(middle[-1])
    for g in range(len(groups) - 2, -1, -1):
        between = F.lit(middle[g]) + (F.col("x") - at[g]) * ((middle[g + 1] - middle[g]) / (at[g + 1] - at[g]))
        usual_ = F.when(F.col("x") <= at[g + 1], between).otherwise(usual_)
    usual_ = F.when(F.col("x") <= at[0], middle[0]).otherwise(usual_)
    off = _quantiles(rows, F.col("ratio") - usual_, [tail, 1 - tail])
    return tuple(Band(float(2**a), m + margin * off[g][0], m + margin * off[g][1]) for g, (a, m) in enumerate(zip(at, middle, strict=True)))


FIELDS = pa.schema(
    [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("zstd_ratio", pa.float64()), ("bad_chunks", pa.float64()), ("reason", pa.string())]
)


def judge(text: str | None, bands: tuple[Band, ...] = BANDS) -> tuple:
    base = base_counts(text)
    failed = base_failed(base)
    whole, bad, why = verdict((text or "").encode("utf-8", "replace"), bands)
    return (*base, failed, not failed and not why, whole, bad, "base" if failed else why)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """doc_id and FIELDS, one row for each row of docs, repeated rows and null ids included, all from its
    whole text. A null or empty text has no words: it fails the base rules. Works row by row; no shuffle."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    found = append_columns(docs.select("doc_id", "_text"), ("_text",), lambda texts: [list(x) for x in zip(*(judge(t, bands) for t in texts), strict=True)] or [[]] * len(FIELDS), FIELDS)
    return found.drop("_text")
