"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import stored


def _mins(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: columns u, v (long). Returns node, root: the smallest node reachable, for every node that
    a link touches. Links to itself, repeated links and nulls change nothing; no link, no row.

    Alternates two steps: every node hands its larger, then its smaller neighbours to the smallest one
    it knows. Only minima are grouped, never whole neighbourhoods, so a node with millions of links is a
    partial aggregate and a join that adaptive execution can split. Each round is written to the shared
    folder; rounds grow with the logarithm of the longest path."""
    now = stored(
        links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    seen = None
    for _ in range(max_rounds):
        # larger neighbours go to the smallest neighbour, or to the node itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_mins(both), "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        # smaller neighbours go to the smallest of them
        least = _mins(large)
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .distinct()
        )
        now = stored(small, "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
