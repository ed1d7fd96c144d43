"""What changed between two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharpsieve.operators.locate import last_of_each
from sharpsieve.operators.rating import bucket

BUCKETS = ("keeper", "middle", "reject", "unrated")


def keyed(photos: DataFrame) -> DataFrame:
    """photos (idx, path, filename, rating, reasons) by key: the path, or the file name where the path is empty; of one key the last counts."""
    key = F.coalesce(F.nullif("path", F.lit("")), F.col("filename"))
    return last_of_each(photos.withColumn("key", key), "key", "idx")


def matched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both runs side by side by key: one full outer join, which all figures read."""
    a, b = (keyed(x).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("idx", "path", "filename", "rating", "reasons")], F.lit(True).alias(f"in_{s}")) for x, s in ((before, "before"), (after, "after")))
    return a.join(b, "key", "full_outer")


def changes(both: DataFrame) -> DataFrame:
    """Frames of both runs whose rating differs (missing is a value): largest move first, then file name, then order in the second run."""
    moved = both.where(F.col("in_before") & F.col("in_after") & ~F.col("rating_before").eqNullSafe(F.col("rating_after")))
    delta = F.coalesce("rating_after", F.lit(0)) - F.coalesce("rating_before", F.lit(0))
    picked = moved.select(
        F.col("key").alias("path"), F.coalesce(F.nullif("filename_after", F.lit("")), "filename_before").alias("filename"),
        F.col("rating_before").alias("from"), F.col("rating_after").alias("to"), delta.alias("delta"),
        F.concat_ws(" -> ", bucket(F.col("rating_before")), bucket(F.col("rating_after"))).alias("transition"),
        F.coalesce("reasons_after", F.expr("cast(array() as array<string>)")).alias("because"), F.col("idx_after").alias("idx"),
    )
    return in_order(picked)


def in_order(moved: DataFrame) -> DataFrame:
    return moved.orderBy(F.desc(F.abs("delta")), "filename", "idx")


def top_movers(both: DataFrame, limit: int = 20) -> DataFrame:
    return changes(both).limit(limit)


def only_in(both: DataFrame, run: str) -> DataFrame:
    """Keys of one run (before or after) that the other hasn't, in order."""
    other = "after" if run == "before" else "before"
    return both.where(F.col(f"in_{run}") & F.col(f"in_{other}").isNull()).select("key").orderBy("key")


def bucket_counts(both: DataFrame) -> DataFrame:
    """bucket, n_before, n_after: all four buckets, zeros too, from one pass."""
    count = lambda name, s: F.count_if(F.coalesce(F.col(f"in_{s}"), F.lit(False)) & (bucket(F.col(f"rating_{s}")) == name))
    one = both.agg(F.array(*[F.struct(F.lit(x).alias("bucket"), count(x, "before").alias("n_before"), count(x, "after").alias("n_after")) for x in BUCKETS]).alias("b"))
    return one.select(F.inline("b"))


def movement(both: DataFrame) -> DataFrame:
    """transition, n: how often a rating moved from one bucket to another (or inside one), most frequent first."""
    return changes(both).groupBy("transition").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "transition")


def shown_names(moved: DataFrame) -> DataFrame:
    """changes with name: the file name, or its last two path parts where several changed frames share the name."""
    n = moved.groupBy("filename").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.filter(F.split("path", r"[/\\]"), lambda x: x != "")
    short = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
    return moved.join(n, "filename").withColumn("name", F.when(F.col("_n") > 1, short).otherwise(F.col("filename"))).drop("_n")
