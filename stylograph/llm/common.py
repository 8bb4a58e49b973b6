"""Helpers the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.session import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: columnar and compressed,
    readable after any executor is lost, and scanned only for the columns asked."""
    folder = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Steps:
    """Tables that the steps of one operator land for each other in a folder each. A table goes after its last reader, all go in the
    end, so an operator's disk is that of neighbouring steps. What outlives the operator is landed by itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def land(self, df: DataFrame, name: str) -> DataFrame:
        folder = scratch(self.spark, name)
        df.write.options(compression="zstd").parquet(folder)
        table = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[table] = folder
        self._collect()
        return table

    def free(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folders.pop(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _collect(self) -> None:
        """Spark deletes shuffle files when the driver has collected the plan they belong to; with a large heap that may be long after."""
        self.spark._jvm.System.gc()

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        self.free(*list(self.folders))
        self._collect()


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
