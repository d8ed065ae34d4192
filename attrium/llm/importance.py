"""Target-distribution importance resampling with a head-tail vocabulary.

Features are words and pairs of consecutive words, hashed by CRC32 to buckets. The words and pairs that the corpus
repeats most are the head: of its words the CRC states (of the word, and of the word with a space behind it, from
which the CRC of any pair goes on) are sent to all tasks, of its pairs the buckets. What isn't in the head takes a
CRC of its own, a pair from the state of its first word. Both give the same bucket, so that totals are exact and
the head only saves work.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import SLICE, append_columns, slices, stored

BUCKETS = 10_000
LEAST_WORDS = 20  # of a document that can be drawn
HEAD_WORDS, HEAD_PAIRS = 1 << 15, 1 << 16  # at most
TABLED = 255  # bytes of a word whose effect on a CRC state is held in tables
ID = 1 << 20  # over the number of words in the head
LONGEST = 64  # bytes of a word in the head: so it has 12 MB at most
COUNTERS = 1 << 16  # of words and of pairs, that a task keeps
WORD, GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in runs of about SLICE bytes."""
    data, at = (text or "").encode("utf-8", "replace").lower(), 0
    while at < len(data):
        gap = GAP.search(data, at + SLICE)
        end = gap.start() if gap else len(data)
        yield WORD.findall(data, at, end)
        at = end


def runs_of(texts: list) -> Iterator[tuple[list[list[bytes]], list[int], int]]:
    """Runs of words, the text that each is of, and how many words at the very beginning were there before. A very long
    text has several runs, each with the last word of the one before, so that no pair is lost."""
    some, of, over = [], [], 0
    for i, text in enumerate(texts):
        last: list[bytes] = []
        for k, run in enumerate(words(text)):
            if k:
                yield some, of, over
                some, of, over = [], [], len(last)
                run = last + run
            some.append(run)
            of.append(i)
            last = run[-1:]
    yield some, of, over


def coded(runs: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of each word of the runs, the words by number, and where pairs begin: all but the runs' last words."""
    code: defaultdict[bytes, int] = defaultdict(count().__next__)
    numbers = np.fromiter(map(code.__getitem__, chain.from_iterable(runs)), np.int64)
    begins = np.ones(len(numbers), bool)
    begins[np.cumsum([len(run) for run in runs], dtype=np.int64)[[len(run) > 0 for run in runs]] - 1] = False
    return numbers, list(code), np.flatnonzero(begins)


def _tables() -> np.ndarray:
    """What n further zero bytes make of a CRC state, for each of its four bytes: states are XORed, as the map is linear."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for n in range(TABLED + 1):
        zeros = bytes(n)
        for bit in range(32):
            moved = np.uint32(crc32(zeros, 1 << bit) ^ crc32(zeros))
            out[n, bit // 8, (np.arange(256) >> bit % 8 & 1).astype(bool)] ^= moved
    return out


class Head:
    """Buckets of features, from the words (w, None) and pairs (w, other) of the head."""

    def __init__(self, found: list[tuple[bytes, bytes | None]]):
        singles = dict.fromkeys(w for pair in found for w in pair if w is not None)
        self.words = {w: (i, *self._states(w)) for i, w in enumerate(singles)}
        pairs = sorted((self.words[w][0] * ID + self.words[other][0], crc32(other, self.words[w][2]) % BUCKETS) for w, other in found if other is not None)
        self.pairs, self.pair_buckets = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([-1], [0])))
        self.tables = _tables()

    @staticmethod
    def _states(w: bytes) -> tuple[int, int]:
        state = crc32(w)
        return state, crc32(b" ", state)

    def features(self, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bucket of each feature of the texts, and the place of its text."""
        for runs, of, over in runs_of(texts):
            words, begins, pairs = self._buckets(runs)
            of = np.repeat(np.array(of, np.int64), [len(run) for run in runs])
            yield np.concatenate([words[over:], pairs]), np.concatenate([of[over:], of[begins]])

    def _buckets(self, runs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of all runs the bucket; of their pairs the place of the first word, and the bucket."""
        numbers, of, begins = coded(runs)
        known = np.array([self.words.get(w) or (-1, *self._states(w)) for w in of], np.int64).reshape(-1, 3)
        size = np.fromiter(map(len, of), np.int64, len(of))
        first, second = numbers[begins], numbers[begins + 1]
        pairs = self._tail(known[first, 2].astype(np.uint32), known[second, 1].astype(np.uint32), size[second], second, of)
        key = np.where((known[first, 0] < 0) | (known[second, 0] < 0), -2, known[first, 0] * ID + known[second, 0])
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return known[numbers, 1] % BUCKETS, begins, np.where(self.pairs[at] == key, self.pair_buckets[at], pairs)

    def _tail(self, state: np.ndarray, own: np.ndarray, size: np.ndarray, second: np.ndarray, of: list[bytes]) -> np.ndarray:
        """Buckets of pairs: the state behind the first word and its space, moved on by the second word."""
        n = np.minimum(size, TABLED)
        crc = own.copy()
        for k in range(4):
            crc ^= self.tables[n, k, state >> np.uint32(8 * k) & np.uint32(255)]
        for i in np.flatnonzero(size > TABLED).tolist():
            crc[i] = crc32(of[second[i]], int(state[i]))
        return crc.astype(np.int64) % BUCKETS


def _trimmed(counts: Counter, most: int) -> Counter:
    """At most `most` of the counts, each less by the largest that goes. What makes up more than 1 / most of all that
    was counted stays, also if counts that were trimmed apart are added up."""
    if len(counts) <= most:
        return counts
    off = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -most - 1)[-most - 1])
    return Counter({k: n - off for k, n in counts.items() if n > off})


def _heavy(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values and their counts, trimmed."""
    found, n = np.unique(values, return_counts=True)
    off = int(np.partition(n, -most - 1)[-most - 1]) if len(n) > most else 0
    return found[n > off], n[n > off] - off


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The values of the first column, some at a time."""
    for b in batches:
        yield from (s.column(0).to_pylist() for s in slices([b], 0))


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, other, n: summaries of the words (other is null) and pairs of all texts, COUNTERS of each at most."""
    singles, pairs = Counter(), Counter()

    def counted(runs: list[list[bytes]], over: int) -> None:
        numbers, of, begins = coded(runs)
        for found, n in zip(*(x.tolist() for x in _heavy(numbers[over:], COUNTERS)), strict=True):
            singles[of[found]] += n
        both = numbers[begins] * len(of) + numbers[begins + 1]
        for found, n in zip(*(x.tolist() for x in _heavy(both, COUNTERS)), strict=True):
            pairs[of[found // len(of)], of[found % len(of)]] += n

    for runs, _, over in (found for texts in _texts(batches) for found in runs_of(texts)):
        counted(runs, over)
        singles, pairs = _trimmed(singles, COUNTERS), _trimmed(pairs, COUNTERS)
    found = [(w, None, n) for w, n in singles.items() if len(w) <= LONGEST]
    found += [(*p, n) for p, n in pairs.items() if max(map(len, p)) <= LONGEST]
    columns = list(zip(*found, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["w", "other", "n"])


def head(texts: DataFrame, text_col: str = "text") -> Head:
    """The words and pairs that texts repeat most, by summaries of all of them; HEAD_WORDS and HEAD_PAIRS at most.
    Counts are cut at a power of two, so no task orders them."""
    summed = stored(texts.select(text_col).mapInArrow(_often, "w binary, other binary, n long").groupBy("w", "other").agg(F.sum("n").alias("n")), "often")
    kind, size = F.col("other").isNull(), F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = summed.groupBy(kind.alias("word"), size.alias("size")).count().collect()  # 64 rows of each kind at most
    floors = {}
    for word, most in ((True, HEAD_WORDS), (False, HEAD_PAIRS)):
        total, floors[word] = 0, 64
        for r in sorted((r for r in sizes if r["word"] == word), key=lambda r: -r["size"]):
            total += r["count"]
            if total > most:
                break
            floors[word] = r["size"]
    chosen = summed.filter(size >= F.when(kind, floors[True]).otherwise(floors[False]))
    return Head([(bytes(r["w"]), None if r["other"] is None else bytes(r["other"])) for r in chosen.select("w", "other").collect()])


def totals(texts: DataFrame, known, text_col: str = "text") -> DataFrame:
    """bucket, n: the features of all texts. known: a broadcast Head."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for texts in _texts(batches):
            for buckets, _ in known.value.features(texts):
                sums += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    return texts.select(text_col).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain: a row for each bucket. raw, target: bucket, n. The gain is that of the logarithm of the target's share
    over the raw one, in thousandths, where each bucket counts once more than it occurs."""
    both = raw.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + BUCKETS) / ((d("s") + 1) * (d("all_t") + BUCKETS))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # sums: one row


WEIGHED = pa.schema([("n_features", pa.int64()), ("weight", pa.int64())])


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", prefix: str = "") -> DataFrame:
    """docs, then n_features and weight (their names after prefix): the floored mean of the gains of a text's features, 0
    without any. A null text has none. Three passes over the texts, of which none is shuffled or stored."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(head(docs, text_col))
    found = gains(stored(totals(docs, known, text_col), "raw-totals"), stored(totals(target, known, target_col), "target-totals"))
    of = np.zeros(BUCKETS, np.int64)
    for r in found.collect():  # BUCKETS rows
        of[r["bucket"]] = r["gain"]
    sent = sc.broadcast(of)

    def each(texts: list) -> list[list]:
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for buckets, of in known.value.features(texts):
            n += np.bincount(of, minlength=len(texts))
            total += np.bincount(of, sent.value[buckets], len(texts)).astype(np.int64)
        return [n.tolist(), (total // np.maximum(n, 1)).tolist()]

    return append_columns(docs, tuple(text_col.split(".")), each, pa.schema([(prefix + f.name, f.type) for f in WEIGHED]))


def noise(doc_id: Column, seed: int = 7) -> Column:
    """Gumbel noise in thousandths that depends on the id alone; a null id is an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], at: str) -> DataFrame:
    """rows with `at`: 1, 2, 3... in that order. Rows are dealt by range and sorted where they are; only the number of
    rows of each partition goes to the driver."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = stored(placed, "placed")
    part = F.shiftright(at, 33)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _before long"))  # a row for each partition
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, part == F.col("_part")).withColumn(at, F.col("_before") + inside + 1).drop("_part", "_before")


def draw(weighed: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """weighed: doc_id, n_features, weight. Adds score (weight plus noise) and rank: documents of least_words words or
    more are drawn by highest score, percent of them (rounded down); ties to the smaller id, a null one last.
    Rank is null for those not drawn. Rows that repeat an id are drawn one by one."""
    rows = stored(weighed.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("row")), "scores")
    may = F.col("n_features") >= 2 * least_words - 1  # n words have n - 1 pairs
    placed = ranked(rows.filter(may), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "rank")
    most = placed.count() * percent // 100
    placed = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(rows.filter(~may).withColumn("rank", F.lit(None).cast("long"))).drop("row")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs: see weigh and draw."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return draw(weigh(rows, target.select(F.col(target_col).alias("text"))).drop("text"), percent)


def drawn(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id was drawn."""
    ids = found.filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_drawn"]), "left_semi")
