"""Reversible line deduplication: exact reference counts, with sharded cuckoo filters in front.

The index keeps three tables in the shared folder:
  postings  a, b, doc_id      which document holds which line key
  refs      a, b, n_docs, last_doc   the exact reference count of each key and its largest doc_id
  filters   shard, buckets, n, slots  a cuckoo filter for each shard, of the keys in min_docs documents or more
insert() and delete() turn an index into a new one, and a filter takes single keys in and out as their
counts cross min_docs, so removing a batch of documents restores the earlier decisions. clean() probes
the filters where the text is read, so only lines that may be repeated are shuffled; filters that are too large
to send stay where they are, and keys are dealt to their shards and probed there. The exact table then removes
the filter's false positives.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import stored

SLOTS = 4  # of a bucket
KICKS = 500
SALTS = 8


def _mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key's two buckets differ by a hash of its fingerprint."""

    def __init__(self, buckets: int, slots: bytes | None = None, n: int = 0):
        self.buckets, self.n = buckets, n
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * buckets))

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """Room for n keys at a load of at most 0.8."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, n) / (0.8 * SLOTS))))))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mixed(keys)
        mark = (h >> np.uint64(48)) | np.uint64(1)
        first = h & np.uint64(self.buckets - 1)
        return mark.astype(np.int64), first.astype(np.int64), (first ^ self._jump(mark)).astype(np.int64)

    def _jump(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if one finds no place: the filter must then be built anew, larger."""
        rng = random.Random(self.n)
        for mark, first, second in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            if not (self._put(first, mark) or self._put(second, mark) or self._kick(rng.choice((first, second)), mark, rng)):
                return False
            self.n += 1
        return True

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def _kick(self, bucket: int, mark: int, rng: random.Random) -> bool:
        for _ in range(KICKS):
            i = SLOTS * bucket + rng.randrange(SLOTS)
            mark, self.slots[i] = self.slots[i], mark
            bucket ^= (mark * 0x5BD1E995) & (self.buckets - 1)
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were put in; one copy of the fingerprint goes for each."""
        for mark, *places in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for i in (SLOTS * b + s for b in places for s in range(SLOTS)):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    self.n -= 1
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(keys)
        table = np.frombuffer(self.slots, np.uint16).reshape(-1, SLOTS)
        return ((table[first] == mark[:, None]) | (table[second] == mark[:, None])).any(axis=1)


KEY_SCHEMA = "a long, b long, doc_id long"
FILTER_SCHEMA = "shard int, buckets long, n long, slots binary, ok boolean"


def _row(shard: int, f: CuckooFilter, ok: bool) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "buckets": [f.buckets], "n": [f.n], "slots": [f.slots.tobytes()], "ok": [ok]})


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    a, f = keys["a"].to_numpy(), CuckooFilter.sized(len(keys))
    while not f.insert(a):
        f = CuckooFilter(2 * f.buckets)
    return _row(int(keys["shard"].iloc[0]), f, True)


def _update(old: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    if old.empty:
        return _build(changes[changes["step"] > 0]) if (changes["step"] > 0).any() else pd.DataFrame(columns=["shard", "buckets", "n", "slots", "ok"])
    row = old.iloc[0]
    f = CuckooFilter(int(row["buckets"]), row["slots"], int(row["n"]))
    f.delete(changes.loc[changes["step"] < 0, "a"].to_numpy())
    new = changes.loc[changes["step"] > 0, "a"].to_numpy()
    ok = f.n + len(new) <= 0.9 * SLOTS * f.buckets and f.insert(new)
    return _row(int(row["shard"]), f, ok)


#: The seed of the second hash; the first has Spark's own, 42.
SEEDS = 42, 7_046_029_254_386_353_131


def line_keys(text: str | None) -> list[tuple[int, int]]:
    """For each line the 128 bits of hash that stand for its key: the line without white space at both
    ends (bytes strip exactly the six ASCII space characters), A-Z lower-cased."""
    keys = [line.strip().lower() for line in (text or "").encode("utf-8", "replace").split(b"\n")]
    return [(_signed(xxhash.xxh64_intdigest(k, SEEDS[0])), _signed(xxhash.xxh64_intdigest(k, SEEDS[1]))) for k in keys]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counted_keys(text: str | None, min_chars: int) -> set[tuple[int, int]]:
    """The keys of min_chars code points or more."""
    found = set()
    for line in set((text or "").encode("utf-8", "replace").split(b"\n")):
        k = line.strip().lower()
        if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode("utf-8")) >= min_chars):
            found.add((_signed(xxhash.xxh64_intdigest(k, SEEDS[0])), _signed(xxhash.xxh64_intdigest(k, SEEDS[1]))))
    return found


@dataclass(frozen=True)
class LineIndex:
    """min_chars: shorter keys are never counted. broadcast_bytes: larger filters are not sent to the
    tasks that read texts; then keys go to the shards, with the same result."""

    spark: SparkSession
    min_chars: int = 20
    min_docs: int = 3
    keys_per_shard: int = 200_000
    broadcast_bytes: int = 64 << 20
    shards: int = 0
    postings: DataFrame | None = None
    refs: DataFrame | None = None
    filters: DataFrame | None = None

    def _postings(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
        rows = docs.mapInPandas(self._keyed(), KEY_SCHEMA)
        again = docs.groupBy("doc_id").count().filter("count > 1")
        return rows if again.isEmpty() else rows.distinct()

    def _keyed(self, maybe=None):
        """Texts to rows of a, b, doc_id; maybe: keeps those of which it says so."""
        least = self.min_chars

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                each = [counted_keys(t, least) for t in rows["text"]]
                found = np.array([k for keys in each for k in keys], np.int64).reshape(-1, 2)
                ids = np.repeat(rows["doc_id"].to_numpy(np.int64), [len(keys) for keys in each])
                if maybe is not None and len(found):
                    hit = maybe(found)
                    found, ids = found[hit], ids[hit]
                yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "doc_id": ids})

        return keyed

    def _filtered(self, keys: DataFrame) -> DataFrame:
        return keys.groupBy("shard").applyInPandas(_build, FILTER_SCHEMA)

    def _shard(self, n: int) -> Column:
        return F.pmod(F.col("b"), F.lit(n)).cast("int").alias("shard")

    def _moved(self, postings: DataFrame, refs: DataFrame) -> LineIndex:
        """The index with these exact tables and filters that follow them."""
        often = refs.filter(F.col("n_docs") >= self.min_docs)
        n = often.count()
        if self.filters is None or n > 4 * self.shards * self.keys_per_shard:
            shards = max(1, -(-n // self.keys_per_shard))
            filters = stored(self._filtered(often.select("a", self._shard(shards))), "filters")
            return replace(self, postings=postings, refs=refs, filters=filters, shards=shards)
        was = self.refs.filter(F.col("n_docs") >= self.min_docs)
        changes = often.join(was, ["a", "b"], "left_anti").select("a", self._shard(self.shards), F.lit(1).alias("step")).unionByName(
            was.join(often, ["a", "b"], "left_anti").select("a", self._shard(self.shards), F.lit(-1).alias("step"))
        )
        filters = stored(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_update, FILTER_SCHEMA), "filters")
        full = filters.filter("not ok").select("shard")
        if not full.isEmpty():
            anew = self._filtered(often.select("a", self._shard(self.shards)).join(full, "shard", "left_semi"))
            filters = stored(filters.filter("ok").unionByName(anew), "filters")
        return replace(self, postings=postings, refs=refs, filters=filters)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Adds documents. Rows that repeat a doc_id, also one that the index holds, count as one document with
        the lines of all; rows without doc_id are left out; a null text is one empty line."""
        new = self._postings(docs, id_col, text_col)
        if self.postings is not None:
            new = new.join(self.postings, ["a", "b", "doc_id"], "left_anti")
        new = stored(new, "postings")
        counts = new.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        if self.refs is None:
            return self._moved(new, stored(counts, "refs"))
        refs = self.refs.unionByName(counts).groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return self._moved(self.postings.unionByName(new), stored(refs, "refs"))

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Takes documents out; ids that the index doesn't hold change nothing. Only the keys of these documents
        are counted again."""
        gone = doc_ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        left = stored(self.postings.join(gone, "doc_id", "left_anti").select("a", "b", "doc_id"), "postings")
        touched = stored(self.postings.join(gone, "doc_id", "left_semi").select("a", "b").distinct(), "touched")
        counts = left.join(touched, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        return self._moved(left, stored(self.refs.join(touched, ["a", "b"], "left_anti").unionByName(counts), "refs"))

    def _probe(self):
        """A function of an array of keys: which may be repeated. None: the filters are too large to send."""
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        if size > self.broadcast_bytes:
            return None
        rows = self.filters.select("shard", "buckets", "n", "slots").collect()  # at most broadcast_bytes
        sent, shards = self.spark.sparkContext.broadcast({r["shard"]: (r["buckets"], bytes(r["slots"]), r["n"]) for r in rows}), self.shards

        def probe(keys: np.ndarray) -> np.ndarray:
            found, shard = np.zeros(len(keys), bool), np.mod(keys[:, 1], shards)
            for s in np.unique(shard).tolist():
                if s in sent.value:
                    found[shard == s] = CuckooFilter(*sent.value[s]).contains(keys[shard == s, 0])
            return found

        return probe

    def _at_shards(self, keys: DataFrame) -> DataFrame:
        """keys that the filter of their shard may hold. A shard is met in SALTS parts, each of which begins with
        its filter and streams its keys; a key that very many documents hold is so dealt out."""
        none = {c: F.lit(None).cast(t) for c, t in (("buckets", "long"), ("n", "long"), ("slots", "binary"))}
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        rows = keys.select(self._shard(self.shards), salt.alias("salt"), *keys.columns, *[v.alias(c) for c, v in none.items()])
        filters = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *[F.lit(0).cast("long").alias(c) for c in keys.columns], "buckets", "n", "slots")

        def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, at = None, (-1, -1)
            for b in batches:
                for place, part in b.groupby(["shard", "salt"], sort=False):
                    if place != at:
                        first = part.iloc[0]
                        at, now = place, CuckooFilter(int(first["buckets"]), first["slots"], int(first["n"])) if first["slots"] is not None else None
                    part = part[part["slots"].isna()]
                    if now is not None and len(part):
                        yield part[now.contains(part["a"].to_numpy(np.int64))][["a", "b", "doc_id"]]

        dealt = filters.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("slots").isNull())
        return dealt.mapInPandas(probed, KEY_SCHEMA)

    def repeated(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and its keys (gone: array of a, b) whose lines it loses."""
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
        probe = self._probe()
        held = docs.mapInPandas(self._keyed(probe), KEY_SCHEMA)
        if probe is None:
            held = self._at_shards(held)
        often = self.refs.filter(F.col("n_docs") >= self.min_docs).select("a", "b", "last_doc")
        lost = held.join(often, ["a", "b"]).filter("doc_id != last_doc")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("gone"))

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with its columns, text_col cut to the kept lines joined by a line feed, in a column of
        structs named `_lines` before it (n_lines, n_dropped, text); nothing else of docs changes.

        A row without doc_id loses nothing; a null text counts as one empty line and stays ''."""
        lost = self.repeated(docs, id_col, text_col).withColumnsRenamed({"doc_id": "_lines_id", "gone": "_lines_gone"})
        found = docs.join(lost, docs[id_col].cast("long") == F.col("_lines_id"), "left")
        cut = F.pandas_udf(_kept, "n_lines long, n_dropped long, text string")
        return found.select(
            cut(docs[text_col], F.col("_lines_gone.a"), F.col("_lines_gone.b")).alias("_lines"),
            *[docs[c] for c in docs.columns],
        )


def _kept(text: pd.Series, gone_a: pd.Series, gone_b: pd.Series) -> pd.DataFrame:
    out = []
    for t, p, q in zip(text, gone_a, gone_b, strict=True):
        t = t or ""
        lines = t.split("\n")
        if p is None or len(p) == 0:
            out.append((len(lines), 0, t))
            continue
        gone = set(zip(p.tolist(), q.tolist(), strict=True))
        kept = [line for line, key in zip(lines, line_keys(t), strict=True) if key not in gone]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One pass over a whole table: LineIndex of docs, then clean(docs). Short keys never reach a filter
    or the exact table, so they are always kept."""
    return LineIndex(docs.sparkSession, min_chars, min_docs).insert(docs).clean(docs)
