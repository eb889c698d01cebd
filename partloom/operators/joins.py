"""Joins that hold up when a side is large or a key is hot.

A side is broadcast only after its size has been measured. Beyond that size
the rows of hot keys are spread over several tasks, cold keys are joined as
Spark sees fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 0.01
SALTS = 64

_ROW_OVERHEAD = 64


def size_in_bytes(df: DataFrame) -> int:
    """Measured size of a frame, as held in memory; nested values by their JSON text."""
    width = F.lit(_ROW_OVERHEAD + 8 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            # An element may be as short as a digit in the text and eight bytes in memory.
            text = F.octet_length(F.to_json(F.struct(column)))
            width = width + 8 * F.coalesce(text, F.lit(0))
    return df.agg(F.sum(width)).first()[0] or 0


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows; at most 1/share of them."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = df.count()
    return counts.where(F.col("_rows") > total * share).select(*keys).collect()


def _is_hot(df: DataFrame, keys: Sequence[str], hot: list) -> Column:
    test = F.lit(False)
    for row in hot:
        match = F.lit(True)
        for key in keys:
            match = match & df[key].eqNullSafe(F.lit(row[key]))
        test = test | match
    return test


def lookup(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join facts to a dimension on same-named keys.

    ``how`` may be ``left``, ``inner``, ``left_semi`` or ``left_anti``. The
    dimension must fit its measured size to be broadcast. A larger one is
    shuffled; the facts of hot keys then go to ``salts`` tasks each, and only
    the few dimension rows of those keys are repeated.
    """
    keys = list(keys)
    if size_in_bytes(dimension) <= max_bytes:
        return facts.join(F.broadcast(dimension), keys, how)
    hot = hot_keys(facts, keys, share)
    if not hot:
        return facts.join(dimension, keys, how)
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    salted = facts.withColumn("_salt", F.when(_is_hot(facts, keys, hot), spread).otherwise(0))
    copies = F.when(
        _is_hot(dimension, keys, hot), F.sequence(F.lit(0), F.lit(salts - 1))
    ).otherwise(F.array(F.lit(0)))
    repeated = dimension.withColumn("_salt", F.explode(copies))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def having(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a match in ``right``.

    The keys of ``right`` are made distinct first, in the same partitioning the
    join needs, so a key that repeats there costs one row.
    """
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def lacking(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a match in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")
