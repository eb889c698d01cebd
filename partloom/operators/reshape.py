"""Deduplication and unpivoting of wide product rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions import text


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames, null where one lacks a column."""
    combined, *others = frames
    for frame in others:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return combined


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key (null equals null): the first by ``order``.

    An aggregate, not a window: each task first reduces its own rows, so a key
    that repeats very often never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return (
        df.groupBy(*keys)
        .agg(first)
        .select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
    )


def mapped_columns(df: DataFrame, mapping: Mapping[str, str]) -> dict[str, str]:
    """The part of a raw-column mapping whose columns the frame has."""
    return {raw: group for raw, group in mapping.items() if raw in df.columns}


def unpivot_codes(
    df: DataFrame, mapping: Mapping[str, str], ids: Sequence[str] = ()
) -> DataFrame:
    """One row (ids, grup, cod) per mapped column and input row, code stripped."""
    columns = mapped_columns(df, mapping)
    if not columns:
        return df.select(*ids, F.lit("").alias("grup"), F.lit("").alias("cod")).limit(0)
    pairs = [
        F.struct(F.lit(group).alias("grup"), text.strip(F.col(raw).cast("string")).alias("cod"))
        for raw, group in columns.items()
    ]
    long = df.select(*ids, F.explode(F.array(*pairs)).alias("pair"))
    return long.select(*ids, "pair.grup", "pair.cod")


def standard_codes(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Distinct (grup, cod) that the mapped columns name."""
    codes = unpivot_codes(df, mapping)
    return codes.where(text.is_standard_code(F.col("cod"))).distinct()


def standard_links(
    df: DataFrame, mapping: Mapping[str, str], sku: str = "cod_sku"
) -> DataFrame:
    """Distinct (sku, grup, cod) links of products to standards."""
    codes = unpivot_codes(df.where(F.col(sku).isNotNull()), mapping, [sku])
    return codes.where(text.is_link_code(F.col("cod"))).dropDuplicates([sku, "grup", "cod"])


def drop_null_rows(df: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """Drop rows where any or all of the columns are null."""
    return df.na.drop(how=how, subset=list(columns))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank stripped values of a column, as ``nume``."""
    names = df.select(text.blank_to_null(F.col(column)).alias("nume"))
    return names.where(F.col("nume").isNotNull()).distinct()
