"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharpsieve.operators.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None, name: str = "cc") -> DataFrame:
    """edges: columns a and b of one orderable type. Returns node, root (its component's smallest node) for every node of an edge.

    One plan for every size. Nothing but counts reaches the driver; each round is a table in the shared folder.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    last, k = None, 0
    while True:
        # large star: what is larger than a node, and the node, to the smallest of its neighbours
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.where("a != b").distinct(), f"{name}-large-{k}")
        # small star: what is smaller than a node, and the node, to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        after = scratch.write(small.where("a != b").distinct(), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}", f"{name}-large-{k}")
        sign = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == last or not sign[0]:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select(F.col("b"), F.col("b")).distinct())
        now, last, k = after, sign, k + 1
