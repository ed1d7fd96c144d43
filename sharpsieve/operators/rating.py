"""Ranking inside groups, and the rule ladder."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharpsieve.config import DEFAULT_RULES, Rule
from sharpsieve.functions.rules import compile_value, ladder, report_names


def rank_in_groups(
    frames: DataFrame, score: Column, *, group_col: str = "group_id", idx_col: str = "file_idx", rank: str = "group_rank", size: str = "group_size"
) -> DataFrame:
    """frames with rank (0 is best; equal scores by idx_col, missing scores last) and size. A row without a group is a group of its own."""
    own = F.when(F.col(group_col).isNull(), F.col(idx_col))
    group = W.partitionBy(group_col, own)
    scored = frames.withColumn("_score", score)
    ranked = scored.withColumns({
        rank: (F.row_number().over(group.orderBy(F.col("_score").desc_nulls_last(), idx_col)) - 1).cast("int"),
        size: F.count(F.lit(1)).over(group).cast("int"),
    })
    return ranked.drop("_score")


def rank_score(rank_by: str, names: Mapping[str, tuple[str, Column]] | None = None) -> Column:
    """The score of a rank_by expression: what isn't a number is missing. While scoring, a frame has no rank and is alone."""
    names = names or report_names(group_rank=F.lit(None).cast("int"), group_size=F.lit(1), is_group_best=F.lit(False))
    value = compile_value(rank_by, names)
    if value.kind not in ("number", "bool"):
        return F.lit(None).cast("double")
    score = value.column.cast("int").cast("double") if value.kind == "bool" else value.column.cast("double")
    return F.when(~F.isnan(score), score)


def rate(frames: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, names: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """frames with rating, label and reasons (reasons that are there come first)."""
    had = {c: F.col(c) for c in ("rating", "label") if c in frames.columns}
    base = F.coalesce("reasons", F.expr("cast(array() as array<string>)")) if "reasons" in frames.columns else None
    rating, label, reasons = ladder(rules, names or report_names(), base=base, **had)
    return frames.withColumns({"rating": rating.cast("int"), "label": label, "reasons": reasons})


def bucket(rating: Column) -> Column:
    return F.when(rating.isNull(), "unrated").when(rating >= 4, "keeper").when(rating <= 2, "reject").otherwise("middle")


def keepers(frames: DataFrame, least: int = 4) -> DataFrame:
    """Frames without an error that are rated `least` or more."""
    return frames.where(_sound() & (F.coalesce("rating", F.lit(0)) >= least))


def rejects(frames: DataFrame, most: int = 2) -> DataFrame:
    """Frames without an error that are rated, `most` at most."""
    return frames.where(_sound() & F.col("rating").isNotNull() & (F.col("rating") <= most))


def _sound() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""
