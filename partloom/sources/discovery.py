"""Find input files below a folder."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def bytes_of_a_task(spark: SparkSession) -> int:
    """Bytes that Spark gives one task of a file it can split."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths and lengths of all files below ``root`` whose name matches a glob.

    Only the listing is read, no file content. Files without any content are
    not listed.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )


def hidden_files(spark: SparkSession, root: str) -> list[str]:
    """Paths below ``root`` that Spark's readers pass over: a leading dot or underscore.

    Files that Spark itself writes beside its output are not among them. The listing
    is the file system's own; no content is read.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    filesystem = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    files = filesystem.listFiles(folder, True)
    while files.hasNext():
        path = files.next().getPath()
        name = path.getName()
        own = name in ("_SUCCESS", "_metadata", "_common_metadata") or name.endswith(".crc")
        if name[0] in "._" and not own:
            found.append(path.toString())
    return sorted(found)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder; an error if that is not done."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    filesystem = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not filesystem.rename(path(source), path(target)):
        raise OSError(f"{source} was not moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def find_file(spark: SparkSession, root: str, patterns: Sequence[str]) -> str | None:
    """The shortest path for the first pattern that matches any file."""
    if not exists(spark, root):
        return None
    for pattern in patterns:
        files = list_files(spark, root, pattern)
        shortest = files.agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))))
        path = shortest.first()[0]
        if path is not None:
            return path
    return None


def find_sources(
    spark: SparkSession, root: str, wanted: dict[str, Sequence[str]]
) -> dict[str, str]:
    """A path per category; a category without a file is warned about and left out."""
    found = {}
    for category, patterns in wanted.items():
        path = find_file(spark, root, patterns)
        if path is None:
            warnings.warn(f"no file for {category} below {root}", stacklevel=2)
        else:
            found[category] = path
    return found
