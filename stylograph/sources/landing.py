"""Landing: the three raw tables, replaced as a whole by every run."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.sources import schemas


def batch_timestamp(at: datetime | None = None) -> Column:
    """One load time for a whole run: UTC wall clock without a zone, fixed on the driver."""
    at = at or datetime.now(timezone.utc).replace(tzinfo=None)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


class Tables:
    """Named tables under one root folder, as parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table and return it as read back: later steps start from the files."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def land(self, name: str, rows: DataFrame, loaded_at: Column) -> DataFrame:
        """Replace a raw table by ``rows`` under its schema; no rows still leave a table."""
        schema = self.spark.createDataFrame([], schemas.RAW[name]).schema
        stamped = rows.withColumn("loaded_at", loaded_at)
        return self.write(name, stamped.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)))


def land_works(tables: Tables, rows: DataFrame, loaded_at: Column) -> DataFrame:
    return tables.land("raw_works", rows, loaded_at)


def land_measurements(tables: Tables, rows: DataFrame, loaded_at: Column) -> DataFrame:
    return tables.land("raw_measurements", rows, loaded_at)


def land_vocab(tables: Tables, rows: DataFrame, loaded_at: Column) -> DataFrame:
    return tables.land("raw_vocab", rows, loaded_at)
