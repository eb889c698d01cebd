"""Raw product files to the wide catalogue."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from partloom.operators.columns import add_wide_defaults, clean_resolved, wide_order
from partloom.operators.reshape import keep_first, union_by_name
from partloom.sources.csv_files import (
    ORDER_COLUMNS,
    FileOutcome,
    layouts_of,
    read_csv,
    read_folder,
    read_products,
    write_csv,
)
from partloom.sources.discovery import exists, find_sources, list_files

log = logging.getLogger(__name__)

# File patterns per category, by preference.
SOURCE_PATTERNS = {
    "CPU": ("cpu.csv", "*cpu*.csv"),
    "Motherboard": ("motherboard.csv", "*mobo*.csv", "*mother*.csv"),
    "RAM": ("memory.csv", "*ram*.csv", "*memory*.csv"),
}

# Name of the folder of files of any category in row counts.
MIXED = "mixed"


def assemble(frames: Sequence[DataFrame]) -> DataFrame:
    """Wide catalogue of resolved frames, with the columns that order its rows.

    The first row of each (SKU, name) stays.
    """
    merged = add_wide_defaults(clean_resolved(union_by_name(frames)))
    ordered = wide_order(merged, keep=ORDER_COLUMNS)
    return keep_first(ordered, ["cod_sku", "denumire"], ORDER_COLUMNS)


def build_wide(
    spark: SparkSession,
    category_root: str,
    mixed_root: str,
    outcomes: list[FileOutcome] | None = None,
) -> DataFrame:
    """Wide catalogue of one file per known category and a folder of mixed files.

    A source that is absent is warned about; it is an error if all are. ``outcomes`` gets a
    line for every input file: whether it was read, and why not.
    """
    frames = []
    found = find_sources(spark, category_root, SOURCE_PATTERNS)
    for rank, category in enumerate(SOURCE_PATTERNS):
        if category in found:
            frames.append(read_products(spark, [found[category]], rank, category, outcomes))
    mixed = read_folder(spark, mixed_root, len(SOURCE_PATTERNS), outcomes)
    if mixed is None:
        warnings.warn(f"no CSV files below {mixed_root}", stacklevel=2)
    frames = [frame for frame in [*frames, mixed] if frame is not None]
    if not frames:
        raise FileNotFoundError(f"no product files below {category_root} or {mixed_root}")
    return assemble(frames)


def write_wide(wide: DataFrame, path: str) -> dict[str, int]:
    """Parquet, with the columns that order the rows.

    Returns the number of rows in all and per source, counted as they are written; they
    go to the log too.
    """
    seen = Observation("wide")
    # One count per known source: the categories' files and the folder of mixed ones.
    sources = [*SOURCE_PATTERNS, MIXED] if "source_rank" in wide.columns else []
    counts = [
        F.count(F.when(F.col("source_rank") == i, 1)).alias(name) for i, name in enumerate(sources)
    ]
    rows = wide.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    rows.write.mode("overwrite").parquet(path)
    log.info("wide catalogue: %s", seen.get)
    return dict(seen.get)


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide catalogue from its CSV form: all text, with the columns that order its rows.

    It is an error if there is no such file. Values may span lines; files are split into
    blocks either way.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    paths = [row.path for row in list_files(spark, path, "*.csv").toLocalIterator()]
    frames = [
        read_csv(spark, files, layout).withColumnsRenamed(
            {f"c{i}": name for i, name in enumerate(layout.header)}
        )
        for layout, files in layouts_of(spark, paths).items()
    ]
    if not frames:
        raise FileNotFoundError(f"no wide catalogue in {path}")
    return union_by_name(frames).withColumn("source_rank", F.lit(0))


def export_wide_csv(wide: DataFrame, path: str) -> None:
    """The sixteen columns as CSV."""
    write_csv(wide.select(*[F.col(c) for c in wide_order(wide).columns]), path)
