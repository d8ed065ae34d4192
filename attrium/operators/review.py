"""Sampling and scoring of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .digests import sorted_digest


def draw(stage: str, stratum, key="source_id"):
    return F.sha2(F.concat_ws(chr(0), F.lit(stage), stratum, F.col(key)), 256)


def stratified_sample(population: DataFrame, stage: str, quotas: dict[str, int], minimum: int) -> DataFrame:
    """population: source_id, review_strata (array). For each stratum in the order of quotas, the rows with
    the lowest hash that aren't chosen yet; then a fill up to minimum. Columns: source_id, stratum, step.

    Of each stratum only as many rows as all quotas together can matter; the steps run on those."""
    total, chosen = sum(quotas.values()), None
    each = population.select("source_id", F.explode("review_strata").alias("stratum")).filter(F.col("stratum").isin(list(quotas)))
    top = each.select("*", draw(stage, F.col("stratum")).alias("h")).withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "source_id"))).filter(F.col("k") <= total).drop("k")
    for step, (stratum, n) in enumerate(quotas.items()):
        left = top.filter(F.col("stratum") == stratum)
        if chosen is not None:
            left = left.join(chosen.select("source_id"), "source_id", "left_anti")
        new = left.orderBy("h", "source_id").limit(n).select("source_id", "stratum", F.lit(step).alias("step"))
        chosen = new if chosen is None else chosen.unionByName(new)
    have = chosen.count()  # at most the sum of the quotas
    if have >= minimum:
        return chosen
    rest = population.select("source_id").join(chosen.select("source_id"), "source_id", "left_anti")
    fill = rest.orderBy(draw(stage, F.lit("minimum-fill")), "source_id").limit(minimum - have)
    return chosen.unionByName(fill.select("source_id", F.lit("minimum-fill").alias("stratum"), F.lit(len(quotas)).alias("step")))


def sample_manifest(population: DataFrame, sample: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """One row for each stratum of quotas: rows available, required, selected and whether it is missing; beside
    them the sizes of population and sample, a digest of the population's ids and a hash over the sorted ids of the
    sample, which is bounded by its quotas. population: source_id, review_strata; sample: source_id, stratum."""
    required = population.sparkSession.createDataFrame(list(quotas.items()), "stratum string, required int")
    available = population.select(F.explode("review_strata").alias("stratum")).groupBy("stratum").agg(F.count("*").alias("available"))
    selected = sample.groupBy("stratum").agg(F.count("*").alias("selected"))
    rows = required.join(available, "stratum", "left").join(selected, "stratum", "left").fillna(0)
    whole = sample.agg(F.count("*").alias("sample"), F.sha2(F.array_join(F.array_sort(F.collect_list("source_id")), "\n"), 256).alias("selection_sha256"))
    return rows.withColumn("missing", F.col("available") == 0).crossJoin(F.broadcast(sorted_digest(population, "source_id").select(F.col("n").alias("population"), F.col("sha256").alias("population_sha256")).crossJoin(whole)))  # one row


def sample_completeness(rated: DataFrame, manifest: DataFrame, quotas: dict[str, int], minimum: int) -> DataFrame:
    """Issues of a rated sample (pos, source_id, stratum) against its manifest (pos, source_id): code and details
    for ids that differ or stand elsewhere, a sample under minimum, and strata short of their quota."""
    both = manifest.withColumnRenamed("source_id", "listed").join(rated.select("pos", "source_id"), "pos", "full").filter(~F.col("listed").eqNullSafe(F.col("source_id")))
    row = lambda df, code, c: df.select(F.lit(code).alias("code"), F.col(c).cast("string").alias("details"))
    size = rated.agg(F.count("*").alias("n"))
    need = rated.sparkSession.createDataFrame(list(quotas.items()), "stratum string, required int")
    have = need.join(rated.groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "left").fillna(0)
    return (
        row(both, "sample_order_mismatch", "pos")
        .unionByName(row(size.filter(F.col("n") < minimum), "sample_too_small", "n"))
        .unionByName(row(have.filter("n = 0 and required > 0"), "stratum_missing", "stratum"))
        .unionByName(row(have.filter("n > 0 and n < required"), "stratum_short", "stratum"))
    )


def score_history(scores: DataFrame) -> DataFrame:
    """scores: stage, run (in order), score, passed. Each with the change from the stage's run before it."""
    by = Window.partitionBy("stage").orderBy("run")
    return scores.select("stage", "run", "score", "passed", F.round(F.col("score") - F.lag("score").over(by), 6).alias("change"))


def strata_coverage(ratings: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """ratings: review, stratum, a row for each rated row. Of each review the strata of quotas that it has rows
    of, over all of them."""
    wanted = F.array(*map(F.lit, sorted(quotas)))
    seen = ratings.groupBy("review").agg(F.collect_set(F.when(F.col("stratum").isin(list(quotas)), F.col("stratum"))).alias("seen"))
    return seen.select("review", F.round(F.size("seen") / F.size(wanted), 6).alias("coverage"), F.array_join(F.array_sort(F.array_except(wanted, "seen")), ",").alias("missing_strata"))


def validate_rubric(rubric: DataFrame) -> DataFrame:
    return rubric.agg((F.sum("weight") == 100).alias("weights_ok"), (F.count_distinct("id") == F.count("*")).alias("ids_ok"))


def read_ratings(wide: DataFrame, dimensions: list[str]) -> tuple[DataFrame, DataFrame]:
    """Long ratings (source_id, dimension, rating), and issues: ratings outside 1 to 5, unknown severities,
    major or critical rows without comment."""
    long = wide.unpivot(["source_id", "severity", "comment"], dimensions, "dimension", "rating")
    bad = long.filter(F.col("rating").isNull() | ~F.col("rating").between(1, 5)).select("source_id", F.lit("rating_out_of_range").alias("code"))
    odd = wide.filter(~F.coalesce("severity", F.lit("")).isin("none", "minor", "major", "critical")).select("source_id", F.lit("unknown_severity").alias("code"))
    mute = wide.filter(F.col("severity").isin("major", "critical") & (F.coalesce(F.trim("comment"), F.lit("")) == "")).select("source_id", F.lit("comment_missing").alias("code"))
    return long.select("source_id", "dimension", "rating"), bad.unionByName(odd).unionByName(mute)


def score_ratings(
    ratings: DataFrame,
    rubric: DataFrame,
    severities: DataFrame,
    passing: float = 85,
    least: float = 3.5,
    major_rate: float = 0.02,
    cap_critical: float = 69,
    cap_major: float = 84,
    incomplete: DataFrame | None = None,
    cap_incomplete: float = 59,
) -> DataFrame:
    """One row for each review: weighted mean of ratings in percent, capped by severities and an incomplete sample, and
    whether it passes. ratings: review, dimension, rating; rubric: id, weight; severities: review, severity (a row for
    each rated row); incomplete: review, of those whose sample lacks rows or strata (see sample_completeness and
    strata_coverage); none if it is left out."""
    means = ratings.groupBy("review", "dimension").agg(F.avg("rating").alias("mean"))
    score = means.join(rubric, means["dimension"] == rubric["id"]).groupBy("review").agg(F.sum(F.col("weight") * F.col("mean") / 5).alias("raw"), F.min("mean").alias("lowest"))
    sev = severities.groupBy("review").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.avg((F.col("severity") == "major").cast("double")).alias("major"))
    rows = score.join(sev, "review")
    if incomplete is not None:
        rows = rows.join(incomplete.select("review").distinct().withColumn("_short", F.lit(True)), "review", "left")
    short = F.coalesce("_short", F.lit(False)) if incomplete is not None else F.lit(False)
    capped = F.least("raw", F.when(F.col("critical") > 0, cap_critical), F.when(F.col("major") > major_rate, cap_major), F.when(short, cap_incomplete))
    rows = rows.withColumn("score", F.round(capped, 6))
    ok = (F.col("score") >= passing) & (F.col("lowest") >= least) & (F.col("critical") == 0) & (F.col("major") <= major_rate) & ~short
    return rows.select("review", F.round("raw", 6).alias("raw"), "score", F.round("lowest", 6).alias("lowest"), "critical", ok.alias("passed"))
