"""Surrogate keys without a single-task numbering step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the bucket number: 4096 buckets, or 65536 for the largest tables.
DIGITS = 3
LARGE_DIGITS = 4

_SEPARATOR = "\x1f"


def key_text(keys: Sequence[str]) -> Column:
    """The natural key as one text, null as blank."""
    return F.concat_ws(
        _SEPARATOR, *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    )


def key_bucket(keys: Sequence[str], digits: int = DIGITS) -> Column:
    """Bucket of a natural key; buckets are alike in size however keys are spelled."""
    return F.conv(F.substring(F.md5(key_text(keys)), 1, digits), 16, 10).cast("bigint")


def assign_ids(
    rows: DataFrame,
    keys: Sequence[str],
    id_column: str,
    taken: DataFrame | int | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """Give rows with distinct natural keys ids above those already taken.

    Rows are numbered inside each bucket of the key, and the bucket is the low
    part of the id. So ids are unique, grow with the row count and depend on
    the data alone: a task that runs again assigns the same ids. ``taken`` is a frame
    with the ids taken, or the highest of them.
    """
    within = Window.partitionBy("_bucket").orderBy(*keys)
    step = (F.row_number().over(within).cast("bigint") - 1) * 16**digits
    identifier = step + F.col("_bucket") + 1
    if isinstance(taken, int):
        identifier = identifier + taken
    elif taken is not None:
        highest = taken.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("highest"))
        identifier = identifier + highest.scalar()
    bucketed = rows.withColumn("_bucket", key_bucket(keys, digits))
    numbered = bucketed.withColumn(id_column, identifier)
    others = [c for c in rows.columns if c != id_column]
    return numbered.select(id_column, *others)
