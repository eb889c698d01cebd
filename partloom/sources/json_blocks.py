"""Files that hold one JSON array of flat objects, read by blocks.

An object without objects inside ends at its only closing brace, so files are cut at
closing braces as text is cut at line ends, and split anywhere. A brace inside a string ends
nothing: whether a piece ends inside a string follows from the quotes before it, whose
number is summed up per block and over the blocks of a file. Files in which no piece has an
odd number of quotes, as one scan tells, need none of that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.operators.joins import lookup
from partloom.session import stored
from partloom.sources.csv_blocks import gathered


def _flips(value: Column) -> Column:
    """Whether a piece changes between inside and outside of strings: 1 or 0."""
    plain = F.regexp_replace(value, r"(?s)\\.", "")
    return (F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))) % 2


def _pieces(
    spark: SparkSession, path: str | Sequence[str], file_pattern: str | None
) -> DataFrame:
    reader = spark.read.option("lineSep", "}")
    if file_pattern:
        reader = reader.option("pathGlobFilter", file_pattern)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
        _flips(F.col("value")).alias("flips"),
    )


def _by_state(pieces: DataFrame) -> DataFrame:
    """Objects of files in which strings hold closing braces."""
    order = Window.partitionBy("file", "block").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_block = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    pieces = stored(pieces, "json-pieces")
    blocks = pieces.groupBy("file", "block").agg(F.sum("flips").alias("turned"))
    starts = blocks.select(
        "file", "block", F.coalesce(F.sum("turned").over(before_block), F.lit(0)).alias("start")
    )
    summed = pieces.withColumn("after", F.sum("flips").over(upto))
    placed = lookup(summed, stored(starts, "json-blocks"), ["file", "block"], "inner").select(
        "file",
        "block",
        "line",
        "value",
        ((F.col("start") + F.col("after") - F.col("flips")) % 2).alias("before"),
        ((F.col("start") + F.col("after")) % 2).alias("after"),
    )
    placed = stored(placed, "json-placed")
    plain = placed.where("before = 0 AND after = 0").select("file", "value")
    spanning = placed.where("before = 1 OR after = 1")
    joined = stored(gathered(spanning, "}", ["file"]), "json-spanning")
    return plain.unionByName(joined.select("file", "value"))


def read_objects(
    spark: SparkSession, path: str | Sequence[str], file_pattern: str | None = None
) -> DataFrame:
    """Rows (file, value): the text of each object in files of JSON arrays.

    For objects that hold no other objects. A file is read by as many tasks as it has
    blocks, be it one line or many.
    """
    pieces = _pieces(spark, path, file_pattern)
    # A row per file that needs more care.
    odd = pieces.where("flips = 1").select("file").distinct()
    if odd.isEmpty():
        found = pieces.select("file", "value")
    else:
        odd = stored(odd, "odd-files")
        even = pieces.join(odd, "file", "left_anti").select("file", "value")
        found = even.unionByName(_by_state(pieces.join(odd, "file", "left_semi")))
    # What stands before the object: the opening bracket, a comma, white space.
    opening = F.regexp_replace("value", r"^[^{]*+", "")
    return found.where(F.contains("value", F.lit("{"))).select(
        "file", F.concat(opening, F.lit("}")).alias("value")
    )
