"""Exact duplicates by polynomial fingerprints that compose.

A text is the polynomial of its bytes, taken at four bases modulo a prime: h(xy) = h(x) * base^len(y) + h(y). So the
chunks of a long text are hashed wherever they are, each is shifted by the length of what follows it, and the sum is
the fingerprint of the text. Texts with equal length and fingerprint are then compared chunk by chunk: all are equal
if the least chunk is the greatest one, which an aggregate finds while it streams through them. Where it is not, the
fingerprints of different texts have met, and their texts are told apart by other bases.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import append_columns, join_unique, stored

PRIME = (1 << 31) - 1
BASES = 4
CHUNK = 1 << 16  # bytes; longer texts are dealt out in chunks
BLOCK = 1 << 13  # bytes whose products (256 x PRIME each) floating point adds up without loss
SENT = 500_000  # classes (five numbers each) that are broadcast; more are joined
CLASS = ["n", "a", "b"]


def bases(turn: int) -> list[int]:
    """The bases of one turn; each turn has others."""
    return np.random.default_rng([31, turn]).integers(1 << 16, PRIME - 1, BASES).tolist()


class Hash:
    """Values of a chunk's polynomial at the bases of a turn."""

    def __init__(self, turn: int):
        self.bases = bases(turn)
        powers = np.ones((BLOCK, BASES), np.float64)
        for i in range(1, BLOCK):
            powers[i] = [int(p) * b % PRIME for p, b in zip(powers[i - 1], self.bases, strict=True)]
        self.powers = powers[::-1].copy()
        self.skip = [pow(b, BLOCK, PRIME) for b in self.bases]

    def of(self, chunk: bytes) -> list[int]:
        data = np.frombuffer(chunk, np.uint8)
        if len(data) <= BLOCK:
            return [int(x) % PRIME for x in data.astype(np.float64) @ self.powers[BLOCK - len(data) :]]
        first = len(data) % BLOCK
        out = self.of(chunk[:first])
        for row in (data[first:].reshape(-1, BLOCK).astype(np.float64) @ self.powers).tolist():
            out = [(h * s + int(x)) % PRIME for h, s, x in zip(out, self.skip, row, strict=True)]
        return out

    def shifted(self, chunk: bytes, after: int) -> list[int]:
        """What a chunk adds to the fingerprint of a text that has `after` bytes behind it."""
        return [h * pow(b, after, PRIME) % PRIME for h, b in zip(self.of(chunk), self.bases, strict=True)]


PARTS = [f"s{i}" for i in range(BASES)]
HASHED = pa.schema([(c, pa.int64()) for c in PARTS])


def _hashed(df: DataFrame, data: Column, after: Column, turn: int) -> DataFrame:
    """df and PARTS: what the chunk `data` adds to its text; null where it is null."""
    sent: list[Hash] = []

    def each(values: list) -> list[list]:
        if not sent:
            sent.append(Hash(turn))
        none = [None] * BASES
        found = [none if v is None else sent[0].shifted(v["data"], v["after"]) for v in values]
        return [list(x) for x in zip(*found, strict=True)] or [[]] * BASES

    return append_columns(df, F.when(data.isNotNull(), F.struct(data.alias("data"), after.alias("after"))), each, HASHED)


def _packed(parts: list[Column]) -> list[Column]:
    """a, b: two values of PRIME in each."""
    x = [F.pmod(p, F.lit(PRIME)) for p in parts]
    return [(x[0] * (1 << 31) + x[1]).alias("a"), (x[2] * (1 << 31) + x[3]).alias("b")]


def _dealt(rows: DataFrame, data: Column) -> DataFrame:
    """row, n, at, data: the chunks of rows' texts, in any task."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int")), lambda i: F.struct(i.alias("at"), F.substring(data, i * CHUNK + 1, F.lit(CHUNK)).alias("data")))
    return rows.select("row", "n", F.explode(cut).alias("c")).select("row", "n", "c.at", "c.data").repartition("row", "at")


def _fingerprints(chunks: DataFrame) -> DataFrame:
    """row, a, b from chunks and their PARTS: sums of shifted values, in any order."""
    return chunks.groupBy("row").agg(*[F.sum(p).alias(p) for p in PARTS]).select("row", *_packed([F.col(p) for p in PARTS]))


def _members(rows: DataFrame, several: DataFrame) -> DataFrame:
    """The rows of classes that have several."""
    return rows.join(F.broadcast(several) if several.count() <= SENT else several, CLASS, "left_semi")


def _printed(texts: DataFrame, text: Column, turn: int) -> tuple[DataFrame, DataFrame]:
    """texts (doc, row, n) with their fingerprint, and the chunks of those that are long. Short texts are hashed where
    they are read, chunks of long ones in any task."""
    texts = stored(_hashed(texts, F.when(F.col("n") <= CHUNK, text), F.lit(0).cast("long"), turn), "texts")
    short = texts.filter(F.col("n") <= CHUNK).select("doc", "row", "n", *_packed([F.col(p) for p in PARTS]))
    long = texts.filter(F.col("n") > CHUNK).select("doc", "row", "n")
    after = F.greatest(F.lit(0).cast("long"), F.col("n") - (F.col("at").cast("long") + 1) * CHUNK)
    chunks = stored(_hashed(_dealt(long, text), F.col("data"), after, turn), "chunks")
    return short.unionByName(long.join(_fingerprints(chunks), "row").select("doc", "row", "n", "a", "b")), chunks


def _classed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """doc, keep_id, group_size, kept of rows. Only classes of several rows are looked up, unless they are more than
    can be broadcast."""
    groups = groups.select(F.struct(*CLASS).alias("class"), "keep", "size")
    rows = rows.select("doc", "row", "id", F.struct(*CLASS).alias("class"))
    several = groups.filter("size > 1")
    if several.count() <= SENT:
        found = rows.join(F.broadcast(several), "class", "left")
    else:
        found = join_unique(rows, groups, "class", groups.select("class", F.col("size").alias("n")))
    keep = F.coalesce("keep", F.struct("id", "row"))
    return found.select("doc", keep["id"].alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), (keep["row"] == F.col("row")).alias("kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, keep_id, group_size, kept for every row of docs; doc is a struct of the row as it came, whatever its columns
    are called.

    Texts are equal if their bytes are; a null text counts as an empty one. Of equal texts the row with the largest
    id stays, and any one of those that repeat it; null ids come before all others, so a group without any other
    has a null keep_id. No row, no result."""
    text = F.coalesce(F.col(f"doc.`{text_col}`").cast("binary"), F.lit(b""))
    texts = docs.select(F.struct("*").alias("doc")).select("doc", F.monotonically_increasing_id().alias("row"), F.octet_length(text).cast("long").alias("n"))
    out = None
    for turn in count():
        rows, chunks = _printed(texts, text, turn)
        rows = rows.withColumn("id", F.col(f"doc.`{id_col}`").cast("long"))
        groups = stored(rows.groupBy(*CLASS).agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("size")), "classes")
        several = groups.filter("size > 1").select(*CLASS)
        parts = chunks.join(rows.filter(F.col("n") > CHUNK).select("row", "a", "b"), "row").select(*CLASS, "at", "data")
        whole = rows.filter(F.col("n") <= CHUNK).select(*CLASS, F.lit(0).alias("at"), text.alias("data"))
        compared = _members(whole, several).unionByName(_members(parts, several)).groupBy(*CLASS, "at").agg(F.min("data").alias("least"), F.max("data").alias("most"))
        mixed = stored(compared.filter("least != most").select(*CLASS).distinct(), "mixed")
        met = not mixed.isEmpty()
        found = _classed(rows.join(mixed, CLASS, "left_anti") if met else rows, groups)
        out = out.unionByName(found) if out is not None else found
        if not met:
            return out
        texts = rows.join(mixed, CLASS, "left_semi").select("doc", "row", "n")
