"""Connected components of a graph given as edges, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the smallest id that can be reached.

    Each step links a vertex's neighbours to the smallest among them, with a group-wise minimum that is combined before the shuffle
    and a join back on narrow rows; a step's table lies in the shared folder. About log(diameter) steps are needed.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "edges")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
        mark = seen
    raise RuntimeError(f"components did not settle in {most} steps")
