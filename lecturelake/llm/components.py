"""Connected components of a graph given as pairs of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the smallest node that can be reached.

    Alternates large-star and small-star steps, which halve distances, until the pairs no longer change. Every step
    is a grouped minimum (combined before the shuffle) and a join with its table, written to the shared folder so that
    Spark can split the neighbours of a hub over tasks; each round is written too. Pairs with a null and loops are left out; repeated pairs count once. An
    empty input gives an empty result.
    """
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    pairs = edges.where(src != dst).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    pairs, before = stored(pairs), None
    while True:
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == before or not after[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select("v", "v").distinct()
            )
        before = after
        pairs = stored(_small_star(_large_star(pairs)))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest node of its neighbourhood."""
    both = pairs.union(pairs.select("v", "u"))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, component) for every node of parents (node, component), which names one smaller node for each.

    component becomes the end of the chain of parents; nodes that have none are left out. Chains halve in each round,
    whose rows are written to the shared folder and joined with themselves. An empty input gives an empty result.
    """
    rows = stored(parents)
    while True:
        up = rows.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = stored(rows.join(up, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")))
        rows = moved.drop("moved")
        if not moved.where("moved").head(1):
            return rows
