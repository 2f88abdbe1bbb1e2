"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join: the relation of a broadcast would be built in the driver's memory,
    at every pass anew, however small."""
    return df.hint("merge")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node now point to its smallest neighbour (or itself)."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(by_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, now point to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(by_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node that has an edge in
    ``edges (u, v)``; self-loops and repeated edges are allowed. Alternating large-star and
    small-star passes: each is a partially aggregated minimum and an equi-join, and the number of
    passes grows with the logarithm of the longest path. Reliable checkpoints cut the lineage."""
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select("u", "v").where("u <> v").distinct().checkpoint()
    seen = None
    while True:
        now = _small_star(_large_star(now)).checkpoint()
        # order-free digest of the edge set: equal sums mean that nothing moved
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = state
