"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharpsieve.operators.scratch import Scratch

__all__ = ["Scratch", "decoded", "encoded", "fold", "free_name", "release", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def encoded(batches: Iterable[pa.RecordBatch], column: str = "_text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with its texts in UTF-8; null becomes the empty text.

    bytes.lower() touches A-Z only and bytes.split() splits at 20 and 09-0D only, as the contracts have it.
    """
    for batch in batches:
        yield batch, [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def decoded(batches: Iterable[pa.RecordBatch], column: str = "_text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch with its texts; null becomes the empty text."""
    for batch in batches:
        yield batch, [x or "" for x in batch.column(column).to_pylist()]


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores in front until no column of df has that name (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what isn't referred to any more; it does so when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
