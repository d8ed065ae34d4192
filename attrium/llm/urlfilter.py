"""URL filter: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

DataFrame and SQL functions throughout; the trees are those of Spark's own machine-learning library. They
learn from all URLs, with or without a rule: blocked are those that a rule blocks or whose host has a word of
a block list; the rest count as allowed. Words and rules themselves are no features, so what the trees carry
over to other hosts is how such URLs look.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    rule: str  # host/path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))

#: Words of a host that label it as gambling, adult, pharmacy, piracy, fraud or advertising.
BLOCK_WORDS = frozenset("adult ads adserver bet bets betting casino cialis crack cracked doubleclick escort gambling jackpot keygen loan loans lottery malware payday phish phishing pill pills poker porn porno sex slots spam sportsbook torrent track tracker viagra warez xxx".split())
FOLDS = 5  # a row's suffix statistics leave out its own fold


def with_parts(df: DataFrame, url: Column) -> DataFrame:
    """Adds host and path; both empty for a null url and one without `://`."""
    at = F.instr(url, "://")
    df = df.withColumn("_rest", F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit("")))
    df = df.withColumn("_rest", F.coalesce("_rest", F.lit("")))
    df = df.withColumn("host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    df = df.withColumn("path", F.regexp_extract(F.expr("substring(_rest, length(host) + 1)"), "^[^?#]*", 0))
    return df.withColumn("host", F.translate("host", UPPER, LOWER)).drop("_rest")


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits host and path; null if none does."""
    fits = lambda r: ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
    by = sorted(rules, key=lambda r: -len(r.rule))
    out = []
    for value in (lambda r: r.rule, lambda r: r.verdict):
        c = F.when(fits(by[0]), value(by[0]))
        out.append(reduce(lambda c, r: c.when(fits(r), value(r)), by[1:], c))  # noqa: B023
    return out[0], out[1]


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "longest_label", "host_entropy", "entropy", "parameters", "fragment", "suffix_rate", "suffix_known")


def with_features(df: DataFrame) -> DataFrame:
    """Adds the lexical features of column _url (never null), and suffix: the host's last label."""
    url = F.col("_url")
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")


    def entropy(c: Column) -> Column:
        share = F.transform(F.array_distinct(F.split(c, "")), lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / F.greatest(F.length(c), F.lit(1)))
        return F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))

    return df.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/[^/]"),
            "labels": count(F.col("host"), "[^.]+"),
            "digits": count(url, "[0-9]") / n,
            "host_digits": count(F.col("host"), "[0-9]"),
            "hyphens": count(F.col("host"), "-"),
            "longest_label": F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x))).cast("double"),
            "host_entropy": entropy(F.col("host")),
            "entropy": entropy(url),
            "parameters": F.when(F.contains(url, F.lit("?")), count(url, "&") + 1).otherwise(0.0),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
        }
    )


def weak_label(verdict: Column) -> Column:
    """1 for a URL that a rule blocks or whose host has a word of BLOCK_WORDS, else 0."""
    words = F.split("host", "[^a-z]+")
    return F.when((verdict == "block") | F.arrays_overlap(words, F.array([F.lit(w) for w in sorted(BLOCK_WORDS)])), 1.0).otherwise(0.0)


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """labelled: suffix, fold, label; all labelled URLs. For each suffix and fold (null: a row of none), the
    smoothed share of blocked URLs and the logarithm of their number, in the other folds."""
    each = labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    every = each.groupBy("suffix").agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    own = every.join(each, "suffix").unionByName(every.select("*", F.lit(None).cast("int").alias("fold"), F.lit(0.0).alias("blocked"), F.lit(0).cast("long").alias("n")))
    blocked, n = F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n")
    return own.select("suffix", "fold", ((blocked + 1) / (n + 2)).alias("suffix_rate"), F.log1p(n).alias("suffix_known"))


def judge_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    train_rows: int = 20_000,
    trees: int = 20,
    depth: int = 4,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    label_col: str | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every row of pages.

    The trees learn from about train_rows URLs (the bound on the sample; drawn by a hash of the URL) and judge
    those that no rule decides: block if the score reaches threshold. label_col names a column of labels (1
    blocked, 0 allowed, null unknown); without one weak_label() says. Suffix statistics (of a host's last
    label) come from all labelled URLs; for a row that is learned from, its own fold is left out. Without
    labelled URLs of both kinds nothing can be learned: the score is 1 if all are blocked, else 0. Null URLs
    and those without `://` have empty host and path and are judged like others; null ids and repeated rows
    stay."""
    known = F.lit(None).cast("double") if label_col is None else F.col(label_col).cast("double")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"), known.alias("_label"))
    rows = with_parts(rows, F.col("_url"))
    rule, verdict = ruled(rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_verdict"))
    label = weak_label(F.col("_verdict")) if label_col is None else F.col("_label")
    labelled = rows.select("_url", "host", "path", label.alias("label"), F.pmod(F.xxhash64("_url", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")).filter("label is not null")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    decided = rows.select("page_id", "host", "path", "rule", "_verdict", F.lit(1.0 if set(sizes) == {1.0} else 0.0).alias("block_score"))
    if len(sizes) == 2:
        share = min(1.0, train_rows / sum(sizes.values()))
        drawn = with_features(labelled.filter(F.pmod(F.xxhash64("_url", F.lit("train")), F.lit(1 << 30)) < share * (1 << 30)))
        suffixes = stored(suffix_statistics(labelled.select(F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"), "fold", "label")), "suffixes")
        put = lambda df, on, known: VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df.join(known, on, "left").fillna({"suffix_rate": 0.5, "suffix_known": 0.0}))
        learned = stored(put(drawn, ["suffix", "fold"], suffixes.filter("fold is not null")).select("features", "label"), "learned")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7).fit(learned)
        open_rows = put(with_features(rows.filter("_verdict is null")), "suffix", suffixes.filter("fold is null").drop("fold"))
        scored = model.transform(open_rows).select("page_id", "host", "path", "rule", "_verdict", vector_to_array("probability")[1].alias("block_score"))
        decided = scored.unionByName(rows.filter("_verdict is not null").select("page_id", "host", "path", "rule", "_verdict", F.lit(None).cast("double").alias("block_score")))
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return decided.select("page_id", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"), F.when(F.col("_verdict").isNull(), F.col("block_score")).alias("block_score"))
