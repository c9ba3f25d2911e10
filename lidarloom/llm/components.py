"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node, root): root is the least node of node's component.

    Alternates the large-star and small-star steps: every node's larger neighbours are tied to its least neighbour,
    then its smaller ones, until nothing changes. Rounds grow with the logarithm of the longest chain; each is a
    grouping with partial minima and a join, so a node of any degree is never held in one place.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        # large star: neighbours above x go to the least of x and its neighbours
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        # small star: x and its smaller neighbours go to the least of them
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low.select("x", F.col("m").alias("y")))
        now = stored(small.filter("x <> y").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).union(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
