"""Tables in the shared folder: they cut lineage, are read more than once, and survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sharpsieve.session import shared_dir


class Scratch:
    """A folder of tables that goes with the driver's end at the latest; what is read no more is dropped before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sharpsieve-{uuid.uuid4().hex}"
        folder, files = self._at(self.root)
        files.mkdirs(folder)
        files.deleteOnExit(folder)  # results are read lazily, so the last tables can't be dropped here

    def _at(self, path: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            folder, files = self._at(f"{self.root}/{name}")
            files.delete(folder, True)
