"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# Keys and counts take some ten times their shuffled bytes in an aggregate and a sort.
SMALL_TASK_BYTES = 16 * 1024 * 1024

# Settings the jobs were planned with; all are Spark's own.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def builder(master: str | None = None) -> SparkSession.Builder:
    b = SparkSession.builder.appName("partloom")
    if master:
        b = b.master(master)
    for name, value in RECOMMENDED.items():
        b = b.config(name, value)
    return b


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the session's JVM ends.

    Where that setting is absent, the warehouse folder serves, which is shared too.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.sql.warehouse.dir"
    )
    parent = f"{shared.rstrip('/')}/partloom/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
    filesystem = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    filesystem.mkdirs(folder)
    filesystem.deleteOnExit(folder)
    return f"{parent}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_tasks(spark: SparkSession, most: int = SMALL_TASK_BYTES) -> Iterator[None]:
    """Tasks of what runs inside take at most about ``most`` shuffled bytes, or the session's fewer.

    The setting is the session's, so only one thread may be inside.
    """
    before = spark.conf.get(TASK_BYTES)
    set_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    spark.conf.set(TASK_BYTES, str(min(set_bytes, most)))
    try:
        yield
    finally:
        spark.conf.set(TASK_BYTES, before)
