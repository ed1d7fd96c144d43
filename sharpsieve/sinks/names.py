"""Distinct output names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharpsieve.functions import paths
from sharpsieve.operators.grouping import dense_ids


def mirrored(frames: DataFrame, suffix: str, *, path_col: str = "path", idx_col: str = "file_idx", out: str = "name") -> DataFrame:
    """frames with out: the path below the deepest common folder, made safe, with suffix; names that would be equal get -2, -3 before the first point.

    The common folder is the longest common start of the smallest and the largest path.
    """
    parts = paths.components(F.col(path_col))
    ends = frames.agg(F.min(parts).alias("a"), F.max(parts).alias("b")).first()
    common = 0
    for x, y in zip((ends.a or [])[:-1], (ends.b or [])[:-1], strict=False):
        if x != y:
            break
        common += 1
    safe = F.array_join(F.transform(F.slice(parts, common + 1, F.size(parts)), paths.safe_part), "/")
    named = frames.withColumn("_safe", F.concat(safe, F.lit(suffix)))
    return _numbered(named, idx_col, out)


def _numbered(named: DataFrame, idx_col: str, out: str) -> DataFrame:
    """The k-th row of one name gets the next number that no plain name has."""
    n = F.row_number().over(W.partitionBy("_safe").orderBy(idx_col))
    counted = named.withColumn("_n", n)
    first = F.regexp_extract("_safe", r"^([^.]*)(.*)$", 1)
    rest = F.regexp_extract("_safe", r"^([^.]*)(.*)$", 2)
    tried = counted.withColumn("_try", F.when(F.col("_n") == 1, F.col("_safe")).otherwise(F.concat(first, F.lit("-"), F.col("_n").cast("string"), rest)))
    clash = tried.where("_n > 1").join(counted.where("_n = 1").select(F.col("_safe").alias("_plain")), F.col("_try") == F.col("_plain")).select(F.col(idx_col).alias("_cidx")).distinct()
    # a numbered name that is another file's plain name also gets its row's index, which nothing else has
    done = tried.join(clash, F.col(idx_col) == F.col("_cidx"), "left")
    return done.withColumn(out, F.when(F.col("_cidx").isNotNull(), F.concat(first, F.lit("-"), F.col("_n").cast("string"), F.lit("-"), F.col(idx_col).cast("string"), rest)).otherwise(F.col("_try"))).drop("_safe", "_n", "_try", "_cidx")


def indexed(frames: DataFrame, suffix: str, *, name_col: str = "filename", idx_col: str = "file_idx", out: str = "name") -> DataFrame:
    """frames with out: 00000-slug, by the order of idx_col (numbers of five digits at least)."""
    order = frames.select(F.col(idx_col).alias("_i"))
    numbers = dense_ids(order, "_i", "_k")
    return frames.join(numbers, F.col(idx_col) == F.col("_i")).withColumn(out, F.concat(F.format_string("%05d", "_k"), F.lit("-"), paths.slug(F.col(name_col)), F.lit(suffix))).drop("_i", "_k")
