"""Rating of reports as they arrive. Measuring and rating need no state; grouping is a global step and stays with the batch run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sharpsieve.config import DEFAULT_RULES, Rule
from sharpsieve.operators.rating import rate
from sharpsieve.schema import REPORT_DDL


def rated_stream(spark: SparkSession, folder: str, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Parquet reports that appear in a folder, each rated as a frame without a group."""
    rows = spark.readStream.schema(REPORT_DDL).parquet(folder)
    alone = rows.withColumns({"group_id": F.lit(None).cast("int"), "group_rank": F.lit(None).cast("int"), "group_size": F.lit(1)})
    return rate(alone.withColumns({"rating": F.lit(None).cast("int"), "label": F.lit(None).cast("string")}), rules)


def write_rated(stream: DataFrame, target: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append rated reports to a Parquet folder; the file sink and the checkpoint give each row once."""
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
