"""Connected components by alternating large-star and small-star steps.

Each step links nodes to the smallest neighbour they know; the edge set
shrinks to stars in a logarithmic number of rounds in practice. Nothing is
gathered: a node's smallest neighbour is a hash aggregate, and links go back
by a join that AQE may split on a node with very many links. Every round is
a written table, so a lost executor never repeats the rounds before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of an
    edge other than a loop; nodes without an edge are not returned."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(e)
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).distinct())
        e = written(small, "small-star")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(e.select("v", "v").distinct())
