"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Whether Spark deletes the shuffle files of a query as soon as the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# Texts that Spark hands to a Python worker at a time; it holds them and so does the worker.
SMALL_BATCH_BYTES = 8 * 1024 * 1024


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends.

    Where that setting is absent, the warehouse folder serves, which is shared too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    path = f"{root.rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    filesystem.mkdirs(folder)
    filesystem.deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows of ``df``, computed once, written, and read back.

    What follows starts from these files, so a lost executor costs only the tasks
    it was running and never the plan above. ``by`` names a column whose values get a
    folder each.
    """
    return written_to(shared_path(df.sparkSession, name), df, by)


def written_to(path: str, df: DataFrame, by: str | None = None, codec: str = "snappy") -> DataFrame:
    """As :func:`written`, in a folder that the caller has named and may remove.

    ``codec`` zstd takes less disk where many columns hold small numbers.
    """
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose result has been written.

    Its cleaner does so once the driver has collected its garbage, which by itself may
    be much later than a chain of large steps can wait.
    """
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_path` whose rows nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = SMALL_BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of what runs inside hold about ``most`` bytes, or the session's fewer.

    The setting is the session's, so only one thread may be inside.
    """
    before = spark.conf.get(BATCH_BYTES)
    set_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(BATCH_BYTES, str(min(set_bytes, most)))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


class Steps:
    """The written steps of one operator, each deleted once nothing will read it again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of ``df`` read back; the shuffle files of the write go when it has ended."""
        self.paths[name] = shared_path(self.spark, name)
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            return written_to(self.paths[name], df, codec="zstd")
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)

    def drop(self, *names: str) -> None:
        """Only for steps that no plan still to run goes back to, lost executors or not."""
        for name in names:
            remove(self.spark, self.paths.pop(name))
        release(self.spark)
