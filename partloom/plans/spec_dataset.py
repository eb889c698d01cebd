"""Listing texts to part files per category, and a folder of part files to its exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from partloom.operators.specs import category_status, gathered, records_of
from partloom.schemas import SPEC_CATEGORIES
from partloom.session import scratch_path, stored
from partloom.sources.discovery import list_files, move, remove
from partloom.sources.parts_files import (
    file_columns,
    read_parts_json,
    to_records,
    write_json_lines,
    write_parts_csv,
)

FILES_AT_A_TIME = 4
# Fixed value: marks the file of a category that broke off.
INCOMPLETE = ".incomplete"


def write_categories(
    raw: DataFrame, root: str, categories: Sequence[str] = SPEC_CATEGORIES
) -> dict[str, str]:
    """One JSON Lines folder per category that has records; returns their load status.

    A category with items left out for an unknown label is marked in its name; one
    without any record is not written. The raw texts are read once, for all categories;
    the records of all are written by one job beside their place and then moved to it, so
    no folder is there in part.
    """
    spark = raw.sparkSession
    path = scratch_path(spark, "items")
    once = gathered(raw.where(F.col("category").isin(*categories)))
    once.write.partitionBy("category").parquet(path)
    items = spark.read.schema(once.schema).parquet(path)
    # A row per category.
    found = {r.category: r for r in category_status(items).collect() if r["items"]}
    names = {
        c: f"{c}{INCOMPLETE if r.load_status == 'incomplete' else ''}.jsonl"
        for c, r in found.items()
    }
    lines = None
    for category, name in names.items():
        records = to_records(records_of(items, category), category)
        line = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
        named = records.select(line.alias("value"), F.lit(name).alias("file"))
        lines = named if lines is None else lines.unionByName(named)
    if lines is None:
        return {}
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    lines.write.partitionBy("file").text(draft)
    for category, name in names.items():
        for old in (f"{category}.jsonl", f"{category}{INCOMPLETE}.jsonl"):
            remove(spark, f"{root}/{old}")
        move(spark, f"{draft}/file={name}", f"{root}/{name}")
    remove(spark, draft)
    return {category: row.load_status for category, row in found.items()}


def export_parts_folder(spark: SparkSession, source: str, target: str) -> DataFrame:
    """JSON Lines and CSV of every part file of a folder, below ``jsonl`` and ``csv``.

    Files are named after categories and may hold a JSON array or JSON Lines; marks of
    incomplete loads are kept. Each file is parsed once, and some files at a time.
    Returns the number of records per category and status.
    """
    container = F.regexp_extract("path", r"^(.*?\.jsonl?)(?:/part-[^/]*)?$", 1)
    # At most two files per category, from the listing.
    listed = list_files(spark, source, "*").select(container.alias("path"), *file_columns())
    known = F.col("category").isin(*SPEC_CATEGORIES) & (F.col("path") != "")
    files = listed.distinct().where(known).collect()
    if not files:
        raise FileNotFoundError(f"no part files below {source}")

    def export(file: Row) -> tuple[str, str, int]:
        category, lines = file.category, file.path.endswith(".jsonl")
        seen = Observation(file.path)
        parsed = read_parts_json(spark, file.path, category, json_lines=lines)
        counted = parsed.observe(seen, F.count(F.lit(1)).alias("parts"))
        records = stored(counted, "parts")
        marker = INCOMPLETE if file.load_status == "incomplete" else ""
        write_json_lines(records, category, f"{target}/jsonl/{category}{marker}.jsonl")
        write_parts_csv(records, category, f"{target}/csv/{category}{marker}.csv")
        return category, file.load_status, seen.get["parts"]

    with ThreadPoolExecutor(FILES_AT_A_TIME) as pool:
        counts = list(pool.map(export, files))
    return spark.createDataFrame(counts, "category string, load_status string, parts long")
