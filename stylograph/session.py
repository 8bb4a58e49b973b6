"""Session set-up and the few physical helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may hold. Checked by counting before every hint, so a side that
# grows with the data falls back to a shuffled join.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 10_000_000
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Of a column's distinct values in a written table; beyond that each value is written out.
DICTIONARY_BYTES = 4 << 20


def get_spark(
    app: str = "stylograph", master: str | None = None, partitions: int | None = None, memory: str | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture costs several round trips per column operation.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; one of our own only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="stylograph-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so later readers do not
    recompute it and a lost executor cannot change it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, for tables of a row per token or term: columnar and compressed, and read for the columns asked."""
    return Kept(df.sparkSession).keep(df)


class Kept:
    """Tables that the steps of one operator write for each other, columnar and compressed; one is removed as soon as the next steps
    no longer read it, so texts lie on disk about twice, whatever the number of steps."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def keep(self, df: DataFrame, share: str | None = None) -> DataFrame:
        """Written; with ``share``, the last column, a folder for each of its few values, so that one is read without the others."""
        folder = f"{checkpoint_folder(self.spark)}/kept-{uuid.uuid4().hex}"
        writer = df.write.options(**{"compression": "zstd", "parquet.dictionary.page.size": DICTIONARY_BYTES})
        if share is None:
            writer.parquet(folder)
        else:
            before = self.spark.conf.get(WRITERS)
            self.spark.conf.set(WRITERS, "64")  # else a task sorts its rows by share, on disk
            try:
                writer.partitionBy(share).parquet(folder)
            finally:
                self.spark.conf.set(WRITERS, before)
        self.folders.append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def forget(self, newest: int = 0) -> None:
        """Remove the tables but for the ``newest`` ones, and what was shuffled for them."""
        gone, self.folders = self.folders[: len(self.folders) - newest], self.folders[len(self.folders) - newest :]
        for folder in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a plan once the driver has collected it."""
    spark._jvm.System.gc()


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core, before costly row work.

    A large table has more splits than cores and stays as it is: its text is never shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def scattered(rows: DataFrame, *keys: str) -> DataFrame:
    """Spread rows that came out of few, very large rows over all shuffle partitions. The number is
    given explicitly: by their bytes alone they would be gathered again."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *keys)


def lookup(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``small`` for broadcast after counting it; beyond ``max_rows`` leave the join to the
    shuffled plan, which adaptive execution balances."""
    if small.limit(max_rows + 1).count() > max_rows:
        return small
    return F.broadcast(small)


def small_texts(small: DataFrame, column: str, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``lookup`` of rows that hold texts, whose length is counted too."""
    chars = small.agg(F.sum(F.length(column))).first()[0] or 0
    return lookup(small, max_rows) if chars <= max_chars else small


def sql_string(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
