"""SimHash near-duplicates: Golay-code fuzzy hashing finds fingerprints within two bits.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most
two bits have some segment without an error whose next segment (cyclically) has one error at most, by the
pigeonhole principle. So each of three tables keys on one exact segment and on the Golay codeword nearest
to the next one: the perfect (23, 12) code maps every 23-bit word to one codeword within three bits. A
fingerprint lives under its own codeword and looks under those of all words one bit away, which finds
every partner; the full Hamming distance then decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .store import append_columns, join_unique, stored

WIDTHS = (22, 21, 21)
#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code.
GOLAY = 0b110001110101
HOT = 256  # fingerprints that live under a key from which midpoints replace pairs; below, what looks there meets so many at most


def _remainders() -> np.ndarray:
    """Of each power of x below 23 by the generator."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GOLAY
    return np.array(out)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 12-bit halves (low, then shifted by 12), and the error of each syndrome."""
    rem = _remainders()
    bits = (np.arange(1 << 12)[:, None] >> np.arange(12)) & 1
    low = np.bitwise_xor.reduce(np.where(bits, rem[:12], 0), axis=1)
    high = np.bitwise_xor.reduce(np.where(bits[:, :11], rem[12:], 0), axis=1)
    error = np.zeros(1 << 11, np.int64)
    for w in range(1, 4):
        for places in combinations(range(23), w):
            error[int(np.bitwise_xor.reduce(rem[list(places)]))] = sum(1 << p for p in places)
    return np.stack([low, high]), error


SYNDROME, ERROR = _tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    s = SYNDROME[0][words & 0xFFF] ^ SYNDROME[1][words >> 12]
    return (words ^ ERROR[s]) >> 11


def fingerprint(text: str | None) -> int:
    """Signed 64 bits."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, six space characters only
    if not words:
        return 0
    if len(words) < 3:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    else:
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-3] + 1).tolist()]
        h = np.fromiter((xxhash.xxh64_intdigest(whole[i:j], 42) for i, j in zip(starts, ends[2:].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[k : k + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return append_columns(docs, ("_text",), lambda texts: [[fingerprint(t) for t in texts]], pa.schema([("fp", pa.int64())])).drop("_text")


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint under its own keys (home) and those where a partner may live."""
    for rows in batches:
        fp = rows["fp"].to_numpy()
        u, parts, shift = fp.view(np.uint64), [], 0
        for w in WIDTHS:
            parts.append(((u >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64))
            shift += w
        for t, w in enumerate(WIDTHS):
            n = (t + 1) % 3
            near = np.stack([parts[n], *(parts[n] ^ (1 << b) for b in range(WIDTHS[n]))], axis=1)
            words = codeword_index(near)
            home = words[:, 0].copy()
            words.sort(axis=1)
            first = np.ones(words.shape, bool)
            first[:, 1:] = words[:, 1:] != words[:, :-1]
            at, _ = np.nonzero(first)
            base = (np.int64(t) << 40) | (parts[t] << 12)
            words = words[first]
            yield pd.DataFrame({"key": base[at] | words, "fp": fp[at], "home": words == home[at]})


def near_links(distinct: DataFrame) -> DataFrame:
    """distinct: column fp, without repeats. Links u, v that connect all fingerprints within two bits of
    each other, directly or through others; every link given is itself within two bits.

    Under a key of more than HOT fingerprints, pairs would grow with the square. Those fingerprints (and
    all that look there) meet at midpoints instead: two within two bits share a word at most one bit from
    both, and each word links all of its fingerprints to the smallest."""
    keys = stored(distinct.select("fp").mapInPandas(_keys, "key long, fp long, home boolean"), "golay")
    home, probe = keys.filter("home").select("key", F.col("fp").alias("u")), keys.select("key", F.col("fp").alias("v"))
    hot = stored(home.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot")
    pairs = home.join(hot, "key", "left_anti").join(probe, "key").filter((F.col("v") < F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)).select("u", "v")
    if hot.isEmpty():
        return pairs
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    words = keys.join(hot, "key", "left_semi").select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return pairs.unionByName(words.join(least, "word").filter("fp != v").select(F.col("fp").alias("u"), "v"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of docs: documents whose fingerprints differ in two bits or
    fewer are linked, and a component is named by its smallest doc_id.

    Null and empty texts have fingerprint 0 and are linked to each other. A null doc_id is no name: such a
    row gets the name of its component, null if no other row is in it. Repeated rows stay."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(near_links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(names, "root").select("fp", "component_id")
    every = stored(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "every")
    return join_unique(prints, every, "fp", distinct.select("fp", "n")).select("doc_id", "fp", "component_id")
