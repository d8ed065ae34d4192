"""Language identification as mixture inference.

Every language is a distribution over hashed character trigrams, learned from labelled texts. A text is
taken for a mixture: expectation-maximisation finds the proportion of each language, and the set of
languages is the one whose likelihood, less a penalty for each language, is largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import append_columns, stored

DIM = 1 << 16  # trigram buckets
SMOOTH = 0.05  # added to each bucket's count
NEAR = 0.1  # log likelihood that expectation-maximisation may lie below the greatest when it ends
CLIMBS = 200  # steps of a climb at most
LANGUAGES = 400  # of a model at most: 100 MB
PENALTY = 0.02  # log likelihood a trigram that each further language must gain, beside half the log of their number


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point its lower-case letter; 32 for anything that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigrams(text: str | None) -> np.ndarray:
    """The bucket of each trigram of letters and single spaces; empty if there is no letter."""
    if not text:
        return np.empty(0, np.int64)
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    a = np.concatenate([[np.uint32(32)], a, [np.uint32(32)]])
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    if len(a) < 3:
        return np.empty(0, np.int64)
    h = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            if len(t := trigrams(text)):
                sums[lang] = sums.get(lang, 0) + np.bincount(t, minlength=DIM)
    for lang, c in sums.items():
        at = np.nonzero(c)[0]
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    p = np.full(DIM, SMOOTH)
    p[rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "p": [(p / p.sum()).astype(np.float32).tobytes()]})


def train(labelled: DataFrame, docs_per_lang: int = 10_000) -> tuple[list[str], np.ndarray]:
    """labelled: doc_id, text, lang. Languages, sorted, and their bucket probabilities.

    Learns from about docs_per_lang texts of each language (that is the bound on the sample, drawn by a
    hash of doc_id), all of them if there are fewer. The model is one vector of 256 KB for each language; more
    than LANGUAGES of them raise an error."""
    labelled = labelled.filter("lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages: the values of lang can't be languages")
    if not sizes:
        return [], np.zeros((0, DIM))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_lang / n))])
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = drawn.select("lang", "text").mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sorted(stored(counts, "trigrams").groupBy("lang").applyInPandas(_packed, "lang string, p binary").collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in rows], np.stack([np.frombuffer(r["p"], np.float32) for r in rows]).astype(np.float64) if rows else np.zeros((0, DIM))


def _climb(p: np.ndarray, n: np.ndarray, w: np.ndarray, near: float) -> np.ndarray:
    """Better proportions of a few languages: expectation-maximisation, speeded up by Newton steps to the edge of
    what is allowed. It ends when no mixture of them is more than `near` better, or after CLIMBS steps."""
    total = n.sum()
    for _ in range(CLIMBS):
        mixed = w @ p
        slope = p @ (n / mixed)
        if slope.max() - total <= near:
            break
        now = n @ np.log(mixed)
        free = (w > 0) | (slope > total)
        f = p[free]
        k = len(f)
        curve = np.ones((k + 1, k + 1))
        curve[:k, :k] = (f * (n / mixed**2)) @ f.T
        curve[:k, :k] += np.eye(k) * 1e-9 * np.trace(curve[:k, :k]) / k
        curve[k, k] = 0
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve, np.append(slope[free] - total, 0))[:k]
        down = step < 0
        far = min(1.0, float((w[down] / -step[down]).min(initial=1.0)))
        new = w * slope / total  # what expectation-maximisation gives
        if far > 1e-3:
            there = np.maximum(0, w + far * step)
            there[there < 1e-12] = 0
            there /= there.sum()
            if n @ np.log(there @ p) > max(now, n @ np.log(new @ p)):
                new = there
        w = new
    return w


def _em(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages in p (one row each), and the log likelihood. It ends when no mixture of
    these languages is more than NEAR better: the likelihood is concave, so its steepest slope bounds that. Languages come
    in one at a time, the steepest first, and those without a share go, so few are weighed at once."""
    total, every = n.sum(), len(p)
    w = np.zeros(every)
    w[np.argmax(np.log(p) @ n)] = 1
    for _ in range(3 * every + 10):
        mixed = w @ p
        slope = p @ (n / mixed)
        if slope.max() - total <= NEAR:
            break
        inside = np.flatnonzero(w > 0)
        new = np.union1d(inside, [np.argmax(slope)])
        start = w[new] * 0.9 + 0.1 * (new == np.argmax(slope))
        w = np.zeros(every)
        w[new] = _climb(p[new], n, start / start.sum(), NEAR / 2)
    return w, float(n @ np.log(w @ p))


def mixture(counts: np.ndarray, at: np.ndarray, p: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts of the buckets at. Proportions over all languages; the selected set, largest proportion
    first (ties: the earlier language), and its proportions.

    The set has the greatest likelihood less the penalty. It grows from the best language by additions; then
    languages are dropped or exchanged as long as that gains. No set is tried that cannot gain: a mixture of k
    languages is at best as likely as that of all, and one more language adds at most what its slope is over the
    number of trigrams."""
    own, part, n = logp[:, at] @ counts, p[:, at], counts.sum()
    every, top = _em(part, counts)
    least = PENALTY * n + 0.5 * np.log(n)
    known: dict[tuple[int, ...], tuple[np.ndarray, float]] = {}
    slopes: dict[tuple[int, ...], np.ndarray] = {}

    def value(chosen: tuple[int, ...]) -> float:
        if chosen not in known:
            known[chosen] = (np.ones(1), float(own[chosen[0]])) if len(chosen) == 1 else _em(part[list(chosen)], counts)
        return known[chosen][1] - least * len(chosen)

    def with_one_more(chosen: tuple[int, ...]) -> np.ndarray:
        """A bound of the value of the set with each language added."""
        if not chosen:
            return own - least
        before = value(chosen)
        if chosen not in slopes:
            slopes[chosen] = part @ (counts / (known[chosen][0] @ part[list(chosen)]))
        return before + np.maximum(slopes[chosen] - n, 0) + NEAR - least

    best = (int(np.argmax(own)),)
    gained = top + NEAR - 2 * least > value(best)
    while gained:
        gained, rest = False, [k for k in np.argsort(-every, kind="stable").tolist() if k not in best]
        others = []
        if top + NEAR - least * (len(best) + 1) > value(best):
            may = with_one_more(best)
            others += [tuple(sorted((*best, k))) for k in rest if may[k] > value(best)]
        less = [tuple(x for x in best if x != out) for out in best]
        others += [x for x in less if x]
        if top + NEAR - least * len(best) > value(best):
            for x in less:
                may = with_one_more(x)
                others += [tuple(sorted((*x, k))) for k in rest if may[k] > value(best)]
        for chosen in others:
            if value(chosen) > value(best):
                best, gained = chosen, True
                break
    w = known[best][0]
    by = np.argsort(-w, kind="stable")
    return every, np.array(best)[by], w[by]


FIELDS = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs, then lang_pred, score, languages, proportions (their names after prefix) of each row.

    score is the proportion of lang_pred among all languages. A text that is null, empty or without a
    letter is `und` with score 0 and no languages; so is every text if the model has learned none."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))  # 256 KB a language

    def each(texts: list) -> list[list]:
        langs, p = sent.value
        p = p.astype(np.float64)
        logp, out = np.log(p), []
        for text in texts:
            t = trigrams(text) if langs else ()
            if not len(t):
                out.append(("und", 0.0, [], []))
                continue
            counts = np.bincount(t, minlength=DIM)
            at = np.nonzero(counts)[0]
            every, chosen, w = mixture(counts[at].astype(np.float64), at, p, logp)
            out.append((langs[chosen[0]], float(min(1.0, every[chosen[0]])), [langs[k] for k in chosen], w.tolist()))
        return [list(x) for x in zip(*out, strict=True)] or [[]] * len(FIELDS)

    return append_columns(docs, tuple(text_col.split(".")), each, pa.schema([(prefix + f.name, f.type) for f in FIELDS]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2. False without id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 10_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions for every row of docs; the model learns
    from rows that aren't held out and have a language. Predictions see the text alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.filter(~held_out(F.col("doc_id"))), docs_per_lang)
    return predict(rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).drop("text")
