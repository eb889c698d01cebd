"""CSV input of unknown layout and encoding, CSV output, and the standards map."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from partloom.functions import decode, text
from partloom.operators.columns import resolve_columns
from partloom.operators.reshape import union_by_name
from partloom.schemas import RESOLVED_COLUMNS
from partloom.sources.csv_blocks import ends_inside, read_records
from partloom.sources.discovery import bytes_of_a_task, exists, hidden_files, list_files

# Columns that put rows in input order: source, file, block of the file, row.
ORDER_COLUMNS = ("source_rank", "source_file", "source_block", "source_row")
# Delimiters a mapping file may use, by preference.
MAP_DELIMITERS = (",", ";", "|", "\t")

UTF8, LATIN1 = "UTF-8", "ISO-8859-1"


class Layout(NamedTuple):
    """What files must share to be read in one scan."""

    header: tuple[str, ...]
    encoding: str
    multi_line: bool
    # Values that span lines, and more bytes than one task should read.
    by_blocks: bool = False


def profile_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file: its header line, size, whether it is UTF-8, whether a value spans lines.

    One streaming pass over the lines, reduced to a row per file.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
        F.is_valid_utf8("value").alias("utf8"),
        ends_inside(F.col("value")).alias("open_quote"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )
    profiled = lines.groupBy("path").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("open_quote").alias("multi_line"),
        F.max("size").alias("size"),
        # Only non-blank lines can be a header; the first of them is.
        F.min_by("value", F.when(F.trim("value") != "", F.col("at"))).alias("first"),
    )
    latin = F.decode(F.col("first").cast("binary"), LATIN1)
    header = F.when(F.col("utf8"), F.col("first")).otherwise(latin)
    return profiled.select("path", "utf8", "multi_line", "size", header.alias("header"))


def header_names(line: str) -> tuple[str, ...]:
    """Column names of a header line; blank and repeated names are numbered."""
    names: list[str] = []
    for i, cell in enumerate(next(csv.reader([line.rstrip("\r")]))):
        name, repeat = cell or f"Unnamed: {i}", 0
        while name in names:
            repeat += 1
            name = f"{cell or f'Unnamed: {i}'}.{repeat}"
        names.append(name)
    return tuple(names)


def read_csv(spark: SparkSession, paths: Sequence[str], layout: Layout) -> DataFrame:
    """Rows of files of one layout, all text, columns ``c0..cn``, with input order.

    Large files are split into blocks, those with values that span lines too.
    """
    if layout.by_blocks:
        return read_records(spark, paths, len(layout.header), layout.encoding == LATIN1)
    schema = ", ".join(f"c{i} string" for i in range(len(layout.header)))
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("encoding", layout.encoding)
        .option("multiLine", layout.multi_line)
        .csv(list(paths))
    )
    return rows.select(
        *rows.columns,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
    )


class FileOutcome(NamedTuple):
    """What became of an input file: ``read``, ``no header`` or ``unreadable``, and why."""

    path: str
    outcome: str
    reason: str | None = None


OUTCOME_DDL = "path string, outcome string, reason string"


def _profiles(
    spark: SparkSession, paths: Sequence[str], failed: list[FileOutcome]
) -> Iterator[Row]:
    """Profiles of the files that can be read whole; the others are added to ``failed``.

    All files are profiled by one job. Only if that fails are they tried in halves, down to
    the files that fail by themselves: a few jobs for each of those.
    """
    try:
        # One row per file reaches the driver, as many as the file listing holds.
        yield from profile_csv(spark, paths).collect()
    except (PySparkException, Py4JJavaError) as error:
        if len(paths) == 1:
            reason = str(error).strip().splitlines()
            failed.append(FileOutcome(paths[0], "unreadable", reason[0][:500] if reason else None))
            return
        half = len(paths) // 2
        yield from _profiles(spark, paths[:half], failed)
        yield from _profiles(spark, paths[half:], failed)


def layouts_of(
    spark: SparkSession, paths: Sequence[str], outcomes: list[FileOutcome] | None = None
) -> dict[Layout, list[str]]:
    """The files of each layout, without those that cannot be read or have no header line.

    Those are warned about; ``outcomes``, where given, gets a line for every file.
    """
    task_bytes = bytes_of_a_task(spark)
    layouts: dict[Layout, list[str]] = {}
    found: list[FileOutcome] = []
    for profile in _profiles(spark, paths, found):
        if profile.header is None:
            continue
        encoding = UTF8 if profile.utf8 else LATIN1
        by_blocks = profile.multi_line and profile.size > task_bytes
        names = header_names(profile.header)
        layout = Layout(names, encoding, profile.multi_line, by_blocks)
        layouts.setdefault(layout, []).append(profile.path)
        found.append(FileOutcome(profile.path, "read"))
    told = {_plain(outcome.path) for outcome in found}
    found += [FileOutcome(path, "no header") for path in paths if _plain(path) not in told]
    for kind, text in (("no header", "have no header"), ("unreadable", "cannot be read")):
        count = sum(outcome.outcome == kind for outcome in found)
        if count:
            warnings.warn(f"{count} files {text}", stacklevel=3)
    if outcomes is not None:
        outcomes.extend(found)
    return layouts


def _plain(path: str) -> str:
    """A path without scheme and escapes, as listings and readers spell it differently."""
    return unquote(urlsplit(path).path) if "://" in path or path.startswith("file:") else path


def write_outcomes(spark: SparkSession, outcomes: Sequence[FileOutcome], path: str) -> None:
    """One row per input file, as Parquet."""
    rows = spark.createDataFrame(list(outcomes), OUTCOME_DDL)
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def read_products(
    spark: SparkSession,
    paths: Sequence[str],
    source_rank: int = 0,
    category_hint: str | None = None,
    outcomes: list[FileOutcome] | None = None,
) -> DataFrame | None:
    """Catalogue columns of product files of any layout, one scan per layout.

    A file that cannot be read, or has no header line, is skipped with a warning and told
    in ``outcomes``. None when no file is left.
    """
    layouts = layouts_of(spark, paths, outcomes)
    frames = []
    for layout, files in layouts.items():
        rows = read_csv(spark, files, layout).withColumn("source_rank", F.lit(source_rank))
        frames.append(resolve_columns(rows, category_hint, layout.header, keep=ORDER_COLUMNS))
    return union_by_name(frames) if frames else None


def read_folder(
    spark: SparkSession,
    root: str,
    source_rank: int = 0,
    outcomes: list[FileOutcome] | None = None,
) -> DataFrame | None:
    """Catalogue columns of every CSV file below a folder; None when there is none."""
    if not exists(spark, root):
        return None
    passed_over = [p for p in hidden_files(spark, root) if p.endswith(".csv")]
    if passed_over:
        warnings.warn(f"Spark does not read hidden files: {passed_over}", stacklevel=2)
    paths = [row.path for row in list_files(spark, root, "*.csv").toLocalIterator()]
    if not paths:
        return None
    return read_products(spark, paths, source_rank, outcomes=outcomes)


def empty_products(spark: SparkSession) -> DataFrame:
    """The frame an absent source gives."""
    columns = ", ".join(f"{c} string" for c in RESOLVED_COLUMNS)
    order = "source_rank int, source_file string, source_block long, source_row long"
    return spark.createDataFrame([], f"{columns}, {order}")


def read_standards_map(spark: SparkSession, path: str, wanted: Sequence[str]) -> dict[str, str]:
    """Raw column to standard group, for the wanted columns; a later row wins.

    The delimiter is the one that splits the header. No file gives an empty map.
    """
    if not exists(spark, path):
        warnings.warn(f"no standards map at {path}", stacklevel=2)
        return {}
    header = spark.read.text(path).where(F.trim("value") != "").first()
    if header is None:
        return {}
    line = header.value.lstrip("﻿")
    delimiter = max(MAP_DELIMITERS, key=line.count)
    names = [name.strip().lower() for name in next(csv.reader([line], delimiter=delimiter))]
    if "raw_column" not in names or "grup" not in names:
        return {}
    raw, group = (text.strip(F.col(f"c{names.index(n)}")) for n in ("raw_column", "grup"))
    rows = (
        spark.read.schema(", ".join(f"c{i} string" for i in range(len(names))))
        .option("header", True)
        .option("escape", '"')
        .option("sep", delimiter)
        .csv(path)
        .select(
            raw.alias("raw"),
            group.alias("grup"),
            F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
        )
        .where((F.col("raw") != "") & (F.col("grup") != ""))
        .where(F.col("raw").isin(*wanted))
    )
    # One row per wanted column, in file order.
    last = rows.groupBy("raw").agg(F.max_by("grup", "at").alias("grup"), F.min("at").alias("at"))
    return {row.raw: row.grup for row in last.orderBy("at").collect()}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; lists and numbers as text, null as nothing."""
    flat = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType.simpleString()
        if kind == "array<double>":
            texts = F.transform(column, lambda x: F.coalesce(decode.plain_number(x), F.lit("")))
            column = F.array_join(texts, ",")
        elif kind == "array<string>":
            column = F.array_join(column, ",", "")
        elif kind == "double":
            column = decode.plain_number(column)
        flat.append(column.alias(field.name))
    (
        df.select(*flat)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
