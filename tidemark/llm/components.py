"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each round is two aggregations with map-side combining and two
joins, written to the shared folder.  Rounds grow with the logarithm of the longest
path.  Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import forget, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node (large: greater ones, else smaller ones) on its least neighbour."""
    both = edges.union(edges.select("b", "a")) if large else edges  # edges run from the greater a to the smaller b
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (its least node) for all nodes of the edges (``a``, ``b``).

    Loops, repeated edges and either direction are fine; nulls are ignored; no edges
    give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a != b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = materialize(edges, name), None
    while True:
        before, edges = edges, materialize(_star(_star(edges, True), False), name)
        forget(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
