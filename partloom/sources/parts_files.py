"""Typed part records in JSON arrays, JSON Lines and CSV, one category per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import decode
from partloom.operators.specs import record_kinds
from partloom.sources.csv_files import write_csv
from partloom.sources.discovery import bytes_of_a_task
from partloom.sources.json_blocks import read_objects

# A file, or the folder that a Spark job wrote, is named after its category;
# a load that broke off is marked.
_FILE_PATH = r"/([^/]+?)(\.incomplete)?\.(?:jsonl?|csv)(?:/part-[^/]*)?$"


def file_columns(path: str = "path") -> list[Column]:
    """Category and load status by the name of a file."""
    name = F.col(path)
    marked = F.regexp_extract(name, _FILE_PATH, 2) != ""
    return [
        F.regexp_extract(name, _FILE_PATH, 1).alias("category"),
        F.when(marked, F.lit("incomplete")).otherwise(F.lit("complete")).alias("load_status"),
    ]


def has_large_files(
    spark: SparkSession, path: str | Sequence[str], file_pattern: str | None
) -> bool:
    """Whether a file has more bytes than Spark gives one task; only the listing is read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", file_pattern or "*")
    lengths = listing.load(path).select("length")
    return not lengths.where(F.col("length") > bytes_of_a_task(spark)).isEmpty()


def count_parts(
    spark: SparkSession,
    path: str | Sequence[str],
    json_lines: bool = False,
    file_pattern: str | None = None,
) -> DataFrame:
    """Number of records per category and load status over the JSON files of a folder."""
    pattern = file_pattern or ("*.jsonl" if json_lines else "*.json")
    if json_lines or not has_large_files(spark, path, pattern):
        reader = spark.read.schema("name string").option("multiLine", not json_lines)
        rows = reader.option("pathGlobFilter", pattern).json(path)
        records = rows.select("name", *file_columns("_metadata.file_path"))
    else:
        records = read_objects(spark, path, pattern).select("value", *file_columns("file"))
    return records.groupBy("category", "load_status").agg(F.count("*").alias("parts"))


def read_category_folder(
    spark: SparkSession, path: str, categories: Sequence[str], json_lines: bool = False
) -> dict[str, DataFrame]:
    """Typed records per category of a folder of files named after categories.

    Files of other categories are not opened. Each frame has a ``load_status``.
    """
    suffix = "jsonl" if json_lines else "json"
    return {
        category: read_parts_json(
            spark, path, category, json_lines, f"{category}{{,.incomplete}}.{suffix}"
        )
        for category in categories
    }


def _numbers_from_json(value: Column) -> Column:
    listed = F.from_json(value, "array<double>")
    single = value.try_cast("double")
    return F.when(value.startswith("["), listed).when(single.isNotNull(), F.array(single))


def _typed(kinds: dict[str, str], raw, numbers, items) -> list[Column]:
    columns = []
    for field, kind in kinds.items():
        value = raw(field)
        if kind == "numbers":
            columns.append(numbers(value).alias(field))
        elif kind == "items":
            columns.append(items(value).alias(field))
        elif kind == "boolean":
            columns.append(
                F.when(value == "true", True).when(value == "false", False).alias(field)
            )
        elif kind == "mixed":
            decoded = numbers(value)
            columns.append(F.when(decoded.isNull(), value).alias(field))
            columns.append(decoded.alias(f"{field}_numbers"))
        else:
            columns.append(value.alias(field))
    return columns


def read_parts_json(
    spark: SparkSession,
    path: str | Sequence[str],
    category: str,
    json_lines: bool = False,
    file_pattern: str | None = None,
) -> DataFrame:
    """Typed records of one category from JSON arrays or JSON Lines.

    Large files of either form are split into blocks. A field that is a number in one record and a list in another is read as text
    first and is a list in all of them.
    """
    kinds = record_kinds(category)
    fields = [f"`{f}` {'array<string>' if k == 'items' else 'string'}" for f, k in kinds.items()]
    schema = ", ".join(["name string", *fields])
    if json_lines or not has_large_files(spark, path, file_pattern):
        reader = spark.read.schema(schema).option("multiLine", not json_lines)
        if file_pattern:
            reader = reader.option("pathGlobFilter", file_pattern)
        rows, file = reader.json(path), "_metadata.file_path"
    else:
        objects = read_objects(spark, path, file_pattern)
        rows = objects.select("file", F.from_json("value", schema).alias("r"))
        rows, file = rows.select("file", "r.*"), "file"
    typed = _typed(kinds, F.col, _numbers_from_json, lambda v: v)
    return rows.select("name", *typed, file_columns(file)[1])


def read_parts_csv(spark: SparkSession, path: str | Sequence[str], category: str) -> DataFrame:
    """Typed records of one category from its CSV form."""
    kinds = record_kinds(category)
    rows = (
        spark.read.schema(", ".join(f"`{c}` string" for c in ("name", *kinds)))
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )

    def numbers(value: Column) -> Column:
        values = F.transform(F.split(value, ","), lambda x: x.try_cast("double"))
        return F.when(F.exists(values, lambda x: x.isNotNull()), values)

    typed = _typed(kinds, F.col, numbers, lambda v: F.split(v, ","))
    return rows.select("name", *typed)


def _number_json(values: Column) -> Column:
    """A list of one as a plain number, a longer one as a JSON list."""
    texts = F.transform(values, lambda x: F.coalesce(decode.plain_number(x), F.lit("null")))
    joined = F.array_join(texts, ",")
    return F.when(F.size(values) == 1, joined).when(
        values.isNotNull(), F.concat(F.lit("["), joined, F.lit("]"))
    )


def to_records(df: DataFrame, category: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records ready for JSON: numbers and lists of numbers share a column."""
    columns = [*keep, F.col("name")]
    for field, kind in record_kinds(category).items():
        column = F.col(field)
        if kind == "numbers":
            column = F.parse_json(_number_json(column))
        elif kind == "mixed":
            listed = F.parse_json(_number_json(F.col(f"{field}_numbers")))
            column = F.coalesce(listed, column.cast("variant"))
        elif kind == "text":
            # A decoded yes or no is a JSON boolean.
            decided = F.when(column.isin("true", "false"), column.cast("boolean"))
            column = F.coalesce(decided.cast("variant"), column.cast("variant"))
        columns.append(column.alias(field))
    return df.select(*columns)


def write_json_lines(df: DataFrame, category: str, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line, null fields kept."""
    to_records(df, category).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parts_csv(df: DataFrame, category: str, path: str, mode: str = "overwrite") -> None:
    """CSV by column name; a mixed field is written as the one value it has."""
    columns = [F.col("name")]
    for field, kind in record_kinds(category).items():
        column = F.col(field)
        if kind == "mixed":
            values = F.col(f"{field}_numbers")
            column = F.coalesce(
                column, F.array_join(F.transform(values, decode.plain_number), ",")
            )
        columns.append(column.alias(field))
    write_csv(df.select(*columns), path, mode)


def write_by_category(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with one folder per category, so that a subset reads only its own."""
    df.write.mode(mode).partitionBy("category").parquet(path)


def read_by_category(
    spark: SparkSession, path: str, categories: Sequence[str] = ()
) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("category").isin(*categories)) if categories else rows
