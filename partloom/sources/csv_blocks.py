"""CSV files whose values span lines, read by blocks.

Whether a line starts inside a quoted value depends on all that is before it, yet a file can
be cut anywhere. A line is a function from "starts inside" to "ends inside", and there are
four: it ends outside or inside whatever it starts as, or it keeps or flips what it starts
as. Such functions compose like sums, so each block works out its own, a running
composition over the blocks of a file, one row each, tells every block how it starts,
and every line follows from its block. Only lines of records that do span lines are then
gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.operators.joins import lookup
from partloom.session import stored

# A line of whole fields that ends inside a quoted one. An inch mark within an
# unquoted field opens nothing.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_OPEN_AT_END = rf'^(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+{_QUOTED}\z'


def ends_inside(line: Column) -> Column:
    """Whether a line that starts outside a quoted value ends inside one."""
    return line.contains('"') & line.rlike(_OPEN_AT_END)


def _state(start: Column, fixed: Column, flips: Column) -> Column:
    """Inside (1) or outside (0) after lines that start so.

    ``fixed`` is the last line that ends the same way however it starts: how it ends, and
    the flips up to it. ``flips`` counts those of all lines.
    """
    return F.when(fixed.isNull(), (start + flips) % 2).otherwise(
        (fixed["ends"] + flips - fixed["flips"]) % 2
    )


def _lines(spark: SparkSession, paths: Sequence[str], latin: bool) -> DataFrame:
    """Lines with what the lines of their block up to them, and before them, amount to."""
    value = F.col("value")
    text = F.decode(value.cast("binary"), "ISO-8859-1") if latin else value
    lines = (
        spark.read.option("lineSep", "\n")
        .text(list(paths))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            text.alias("value"),
        )
    )
    outside = ends_inside(F.col("value")).cast("int")
    # A line that starts inside a value reads as if it had that value's opening quote.
    inside = F.when(~F.col("value").contains('"'), 1).otherwise(
        ends_inside(F.concat(F.lit('"'), "value")).cast("int")
    )
    marked = lines.withColumns({"outside": outside, "inside": inside})
    order = Window.partitionBy("file", "block").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flip = (F.col("outside") > F.col("inside")).cast("int")
    marked = marked.withColumn("flips", F.sum(flip).over(upto))
    fixed = F.when(
        F.col("outside") == F.col("inside"),
        F.struct(F.col("outside").alias("ends"), F.col("flips").alias("flips")),
    )
    marked = marked.withColumn("fixed", F.last(fixed, ignorenulls=True).over(upto))
    return marked.withColumns(
        {
            "flips_before": F.coalesce(F.lag("flips").over(order), F.lit(0)),
            "fixed_before": F.lag("fixed").over(order),
        }
    ).drop("outside", "inside")


def _blocks(lines: DataFrame) -> DataFrame:
    """A row per block: whether it starts inside a value, and the header line of its file."""
    visible = F.when(F.trim("value") != "", F.struct("block", "line"))
    summed = lines.groupBy("file", "block").agg(
        F.max_by("flips", "line").alias("flips"),
        F.max_by("fixed", "line").alias("fixed"),
        F.min(visible).alias("header"),
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = F.when(F.col("fixed").isNull(), F.col("flips")).otherwise(0)
    summed = summed.withColumn("turned", F.coalesce(F.sum(turned).over(upto), F.lit(0)))
    ends = _state(F.lit(0), F.col("fixed"), F.col("flips"))
    fixed = F.when(
        F.col("fixed").isNotNull(), F.struct(ends.alias("ends"), F.col("turned").alias("flips"))
    )
    whole = Window.partitionBy("file")
    return summed.select(
        "file",
        "block",
        _state(
            F.lit(0),
            F.last(fixed, ignorenulls=True).over(before),
            F.coalesce(F.lag("turned").over(order), F.lit(0)),
        ).alias("start"),
        F.min("header").over(whole)["line"].alias("header"),
    )


def gathered(parts: DataFrame, separator: str, by: Sequence[str]) -> DataFrame:
    """Records of several lines in one row each, named by their first line.

    ``parts`` has file, block, line, value, the columns ``by``, and before: 0 where a record
    starts. Returned: ``by``, block and line of the first line, and the joined value.
    """
    order = Window.partitionBy("file", "block").orderBy("line")
    opens = F.when(F.col("before") == 0, F.struct("block", "line"))
    parts = parts.withColumn("head", F.last(opens, ignorenulls=True).over(order))
    # Lines at the start of a block may belong to a record of an earlier one.
    last = parts.groupBy("file", "block").agg(F.max("head").alias("head"))
    earlier = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = last.select(
        "file", "block", F.last("head", ignorenulls=True).over(earlier).alias("carried")
    )
    headed = lookup(parts, carried, ["file", "block"]).withColumn(
        "head", F.coalesce("head", "carried")
    )
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    return (
        headed.groupBy(*by, "head")
        .agg(F.array_join(F.transform(pieces, lambda p: p["value"]), separator).alias("value"))
        .select(
            *by,
            F.col("head")["block"].alias("block"),
            F.col("head")["line"].alias("line"),
            "value",
        )
    )


def read_records(
    spark: SparkSession, paths: Sequence[str], columns: int, latin: bool = False
) -> DataFrame:
    """Rows of CSV files without their header, all text, columns ``c0..cn``.

    With source_file, source_block and source_row, which put rows in the order of
    the files. Lines are told apart by ``\\n``; a ``\\r`` at the end of a record is dropped.
    Files are split like any text; the lines of one record must fit in a task, and a quote
    that is never closed makes one record of what follows it in its file.
    """
    lines = stored(_lines(spark, paths, latin), "csv-lines")
    # A row per block, and the records that span lines: made once, however often the rows
    # are read.
    placed = lookup(lines, stored(_blocks(lines), "csv-blocks"), ["file", "block"], "inner")
    placed = placed.select(
        "file",
        "header",
        "block",
        "line",
        "value",
        _state(F.col("start"), F.col("fixed_before"), F.col("flips_before")).alias("before"),
        _state(F.col("start"), F.col("fixed"), F.col("flips")).alias("after"),
    )
    plain = placed.where("before = 0 AND after = 0").drop("before", "after")
    spanning = placed.where("before = 1 OR after = 1")
    joined = stored(gathered(spanning, "\n", ["file", "header"]), "csv-spanning")
    records = plain.unionByName(joined).where(
        (F.trim("value") != "") & (F.col("line") != F.col("header"))
    )
    text = F.regexp_replace("value", r"\r\z", "")
    schema = ", ".join(f"c{i} string" for i in range(columns))
    parsed = records.withColumn("row", F.from_csv(text, schema, {"escape": '"'}))
    return parsed.select(
        *[F.col("row")[f"c{i}"].alias(f"c{i}") for i in range(columns)],
        F.col("file").alias("source_file"),
        F.col("block").alias("source_block"),
        F.col("line").alias("source_row"),
    )
