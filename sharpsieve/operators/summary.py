"""Figures of a run, and the review sheet's filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharpsieve.operators.scratch import Scratch


def summarise(frames: DataFrame) -> DataFrame:
    """One row: total, failed, analysed, groups, in_multi_frame_groups, subject_found; frames has group_id, group_size, error, subject_found."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return frames.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), F.count_if(~failed).alias("analysed"), F.count_distinct("group_id").alias("groups"),
        F.count_if(F.col("group_size") > 1).alias("in_multi_frame_groups"), F.count_if(F.col("subject_found")).alias("subject_found"),
    )


def counted(frames: DataFrame, key: Column, where: Column | None = None) -> DataFrame:
    """key, n: rows by a key that isn't null, most frequent first, then by key."""
    rows = frames.where(key.isNotNull() if where is None else where & key.isNotNull())
    return rows.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def count_map(counts: DataFrame) -> DataFrame:
    """counted, as one ordered map."""
    return counts.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "key", "n"))), lambda x: F.struct(x["key"], x["n"]))).alias("counts"))


def sources(frames: DataFrame) -> DataFrame:
    return frames.select("subject_source").distinct().orderBy("subject_source")


def sheet_filter(*, least: int = 0, source: str | None = None, best_only: bool = False, problems: bool = False, text: str = "") -> Column:
    """The sheet's filters together. A missing rating counts as 0 for `least` and as 5 for problems."""
    test = F.coalesce("rating", F.lit(0)) >= least
    if source:
        test = test & (F.col("subject_source") == source)
    if best_only:
        test = test & F.col("is_group_best")
    if problems:
        test = test & ((F.coalesce("error", F.lit("")) != "") | (F.coalesce("rating", F.lit(5)) <= 2))
    if text.strip():
        test = test & F.contains(F.lower("filename"), F.lit(text.strip().lower()))
    return test


def sheet_order(key: str, descending: bool = True, kind: str = "number") -> list[Column]:
    """Sort columns: a missing rating or group counts as -1, another missing number is the least; ties go by subject_background_ratio the same way."""
    if key in ("rating", "group_id"):
        first = F.coalesce(F.col(key), F.lit(-1))
    else:
        first = F.coalesce(F.col(key), F.lit("")) if kind == "text" else F.col(key)
    columns = [first, F.col("subject_background_ratio")]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in columns]


def numbered(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """rows with out: 1, 2, ... in order. Ranges are numbered apart and shifted by the counts before them, so no task sees all rows."""
    scratch = Scratch(rows.sparkSession)
    once = scratch.write(rows, "rows")  # dealing out by range reads its input twice
    spread = scratch.write(once.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    counts = {r._part: r["count"] for r in spread.groupBy("_part").count().collect()}  # as many as there are ranges
    shifts = [(k, sum(n for j, n in counts.items() if j < k)) for k in counts]
    starts = rows.sparkSession.createDataFrame(shifts, "_part int, _start long")
    at = F.col("_at") - F.col("_part").cast("long") * (1 << 33) + 1  # the id counts up from the part's own base
    return spread.join(F.broadcast(starts), "_part").withColumn(out, at + F.col("_start")).drop("_part", "_start", "_at")
