"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlwarden.session import materialise


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge of u with m, the smallest of u and its neighbours in the table."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    # u > v in every table of edges, before and after
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    hung = _star(edges)
    moved = hung.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(hung.select("u", F.col("m").alias("v"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node, and that on none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("low"), F.lit(1).alias("top")))
    per_node = ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return per_node.where("low > 1 OR low > 0 AND top > 0").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (u, v) of longs; component is the smallest
    node that can be reached. Loops, nulls and repeated edges are ignored; no edges give no rows.

    Each round is written to the shared folder, so plans stay short and lost executors cost a
    re-read. Hubs are met by partial minima and by the adaptive split of skewed joins.
    """
    state = materialise(
        edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        .where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _only_stars(state):
        state = materialise(_small_star(_large_star(state)), "edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
