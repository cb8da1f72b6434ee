"""Connected components of an edge table, by alternating neighbourhood minima; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """Columns a, b (long) to id, component: the smallest id reachable, for every id that has an edge.

    Null ends and self-loops are ignored, repeated edges count once, no edges give no rows.
    Each round hooks every node's neighbours to its smallest one (large star, then
    small star); rounds are logarithmic in practice, and each is a written table.  Hub
    nodes are harmless: minima pre-aggregate and are written, so the joins that
    follow are of plain exchanges, which AQE may split.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while True:
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u's smaller neighbours and u itself are tied to the smallest of them
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(edges, least, large, lower)
        # a fixed point: all edges are stars around roots
        roots = new.select(F.col("v").alias("u")).distinct()
        tied = new.join(roots, "u", "left_semi").limit(1).count()
        twice = new.groupBy("u").count().filter("count > 1").limit(1).count()
        if not tied and not twice:
            break
        edges = new
    return new.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
