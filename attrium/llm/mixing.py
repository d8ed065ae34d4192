"""Mixing sources to target weights: iterative proportional fitting, then sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

DIMS = ("source", "lang", "topic")
#: Targets are the shares of tokens raised to these powers, scaled to one: under 1 lifts rare values.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
NONE = "(none)"


def tokens(text: Column) -> Column:
    """Words of a text, as runs of anything but the six ASCII space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form(text: Column) -> Column:
    """A coarse kind of text, for tables without a topic: table (cells between bars), symbols or digits
    (over a tenth of the characters), short (under 400 characters) or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    return (
        F.when(text.isNull(), NONE)
        .when(share(r" \| ") > 0.02, "table")
        .when(share(r"[#*$%&<>]") > 0.1, "symbols")
        .when(share("[0-9]") > 0.1, "digits")
        .when(F.length(text) < 400, "short")
        .otherwise("prose")
    )


def targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Tokens that each value of dim shall have; they sum to all tokens."""
    shares = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("had"))
    total = shares.agg(F.sum("had").alias("all"), F.sum(F.pow("had", F.lit(power))).alias("powers"))
    return shares.crossJoin(F.broadcast(total)).select(dim, (F.pow("had", F.lit(power)) / F.col("powers") * F.col("all")).alias("target"))  # total: one row


CELLS = 1_000_000  # of a table that one task fits; a larger one is fitted by joins
NEAR = 1e-11  # of themselves that marginals may be off their targets
WORK = 2_000_000_000  # cells times rounds of one task; 20,000 rounds at most


def _fit(tokens: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, bool]:
    """Ratio of each cell, and whether all marginals are met. at: of each dimension the number of each cell's value."""
    factors = [np.ones(len(t)) for t in targets]
    off = np.inf
    for _ in range(max(1, min(20_000, WORK // max(1, len(tokens))))):
        off = 0.0
        for d, target in enumerate(targets):
            w = tokens.copy()
            for o, f in enumerate(factors):
                if o != d:
                    w *= f[at[o]]
            had = np.bincount(at[d], w, len(target))
            new = np.where(had > 0, target / np.where(had > 0, had, 1), 1)
            off = max(off, float(np.abs(new / factors[d] - 1).max(initial=0)))
            factors[d] = new
        if off <= NEAR:
            break
    ratio = np.ones(len(tokens))
    for a, f in zip(at, factors, strict=True):
        ratio *= f[a]
    return ratio, off <= NEAR


def rake(cells: DataFrame, wanted: dict[str, DataFrame]) -> DataFrame:
    """cells: the dimensions and tokens, one row each; wanted: of each dimension value and target. Adds ratio, fitted
    tokens over own tokens, and settled.

    The fitted table is tokens x one factor for each value of each dimension; a round sets the factors of
    one dimension after the other so that its marginal is met, until all are met within NEAR of themselves. Targets
    that empty cells leave out of reach never settle: then settled is false, and the last dimension's marginal is
    the one that is met. CELLS at most are fitted in one task, on arrays; more in sums and joins."""
    dims = list(wanted)
    if cells.count() > CELLS:
        return _rake_by_joins(cells, wanted)
    rows = cells.select(*dims, "tokens")
    for d in dims:
        rows = rows.join(wanted[d].withColumnRenamed("target", f"_t_{d}"), d)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        at, targets = [], []
        for d in dims:
            codes, values = pd.factorize(part[d])
            at.append(codes)
            targets.append(part.groupby(codes)[f"_t_{d}"].first().to_numpy() if len(values) else np.empty(0))
        ratio, settled = _fit(part["tokens"].to_numpy(np.float64), at, targets)
        return part[[*dims, "tokens"]].assign(ratio=ratio, settled=settled)

    kinds = ", ".join(f"{d} string" for d in dims)
    return rows.groupBy(F.lit("all").alias("cells")).applyInPandas(fit, f"{kinds}, tokens long, ratio double, settled boolean")


def _rake_by_joins(cells: DataFrame, wanted: dict[str, DataFrame], rounds: int = 200) -> DataFrame:
    """The same by sums and joins of cells and factors; every step is written, so that plans stay short."""
    dims = list(wanted)
    factors = {d: wanted[d].select(d, F.lit(1.0).alias(f"f_{d}")) for d in dims}
    off = float("inf")
    for _ in range(rounds):
        off = 0.0
        for d in dims:
            now, w = cells, F.col("tokens").cast("double")
            for o in dims:
                if o != d:
                    now, w = now.join(factors[o], o), w * F.col(f"f_{o}")
            had = now.groupBy(d).agg(F.sum(w).alias("had")).join(factors[d], d)
            new = wanted[d].join(had, d).select(d, F.when(F.col("had") > 0, F.col("target") / F.col("had")).otherwise(1.0).alias(f"f_{d}"), F.col(f"f_{d}").alias("before"))
            new = stored(new, f"factors-{d}")
            off = max(off, new.agg(F.max(F.abs(F.col(f"f_{d}") / F.col("before") - 1))).first()[0] or 0.0)
            factors[d] = new.drop("before")
        if off <= NEAR:
            break
    out, ratio = cells, F.lit(1.0)
    for d in dims:
        out, ratio = out.join(factors[d], d), ratio * F.col(f"f_{d}")
    return out.withColumns({"ratio": ratio, "settled": F.lit(off <= NEAR)}).drop(*[f"f_{d}" for d in dims])


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_cells(docs: DataFrame, topic: Column, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """doc, a struct of each row as it is, and cell: source, lang, topic and tokens."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.select(F.struct("*").alias("doc"), F.struct(name(F.col(source_col)).alias("source"), name(F.col(lang_col)).alias("lang"), name(topic).alias("topic"), tokens(F.col(text_col)).alias("tokens")).alias("cell"))


def calibrated(rows: DataFrame, powers: dict[str, float] | None = None) -> DataFrame:
    """rows: source, lang, topic, tokens. The cells and the ratio that a token of each shall count (see mix)."""
    powers = powers or POWERS
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "marginals")
    fitted = rake(cells, {d: stored(targets(cells, d, powers[d]), f"targets-{d}") for d in DIMS})
    return stored(fitted.select(*DIMS, F.when(F.col("tokens") > 0, F.col("ratio")).otherwise(1.0).alias("ratio"), "settled"), "ratios")


def copies(ratio: Column, share: float, doc_id: Column) -> Column:
    """How often a document is drawn: share x ratio in expectation, also where that is over 1."""
    x = ratio * share
    return (F.floor(x) + F.when(chance(doc_id) < x - F.floor(x), 1).otherwise(0)).cast("long")


SENT = 100_000  # cells (about 60 bytes each) that are broadcast; more are joined


def resample(docs: DataFrame, topic: Column, share: float = 0.8, powers: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, each as often as it is drawn: tokens have the target marginals in expectation, with no
    weights left to carry. Texts aren't shuffled: what is joined to them are the ratios of their cells."""
    rows = with_cells(docs, topic, text_col, source_col, lang_col)
    ratios = calibrated(stored(rows.select("cell.*"), "rows"), powers).select(F.struct(*DIMS).alias("key"), "ratio")
    ratios = F.broadcast(ratios) if ratios.count() <= SENT else ratios
    drawn = rows.join(ratios, F.struct(*[F.col(f"cell.{d}").alias(d) for d in DIMS]) == F.col("key"))
    drawn = drawn.withColumn("copies", copies(F.col("ratio"), share, F.col(f"doc.`{id_col}`"))).filter("copies > 0")
    return drawn.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def mix(docs: DataFrame, topic: Column, share: float = 0.8, powers: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, source, lang, topic, tokens, ratio, probability, weight, kept, copies, and
    settled: whether all targets could be met.

    Token weights are raked to the targets of source, language and topic (see POWERS). ratio is what a
    token of the document's cell shall count; a document is kept with probability min(1, share x ratio),
    and a kept one counts weight times, so weighted tokens have the target marginals in expectation, at
    share of the volume; copies draws whole documents instead of weights. A null source, language or topic is a
    value of its own, `(none)`. Documents without a word have ratio 1 if their cell has no token at all.
    Repeated rows count each, and are kept or dropped together."""
    rows = stored(with_cells(docs, topic, text_col, source_col, lang_col).select(F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), "cell.*"), "rows")
    p = F.least(F.lit(1.0), F.col("ratio") * share)
    found = rows.join(calibrated(rows, powers), list(DIMS)).withColumn("probability", p)
    return found.select("doc_id", *DIMS, "tokens", "ratio", "probability", (F.col("ratio") * share / F.col("probability")).alias("weight"), (chance(F.col("doc_id")) < F.col("probability")).alias("kept"), copies(F.col("ratio"), share, F.col("doc_id")).alias("copies"), "settled")
