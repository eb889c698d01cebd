"""Declared keys and domains as data-quality jobs: each returns violations.

Violations are counted per key before any shuffle, so a key that is wrong in
very many rows is one row of the report.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.operators.joins import lacking


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count ``cnt``."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("cnt"))
    return counts.where(F.col("cnt") > 1)


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent and their row count; null refers to none."""
    referenced = child.where(F.col(foreign_key).isNotNull())
    counts = referenced.groupBy(foreign_key).agg(F.count("*").alias("cnt"))
    parents = parent.select(F.col(key).alias(foreign_key))
    return lacking(counts, parents, [foreign_key])


def outside_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside a domain and their row count; null is no value."""
    wrong = df.where(~F.col(column).isin(*allowed))
    return wrong.groupBy(column).agg(F.count("*").alias("cnt"))


# Keys, references and domains of the catalogue.
UNIQUE_KEYS = (
    ("manufacturer", ("nume",)),
    ("category", ("nume",)),
    ("standard", ("grup", "cod")),
    ("product", ("cod_sku",)),
    ("product_standard", ("produs_id", "standard_id")),
    ("warehouse", ("nume", "oras", "tara")),
    ("stock", ("produs_id", "depozit_id")),
    ("order_line", ("cv_id", "linie_nr")),
)
FOREIGN_KEYS = (
    ("product", "categorie_id", "category", "categorie_id"),
    ("product", "producator_id", "manufacturer", "producator_id"),
    ("product_standard", "produs_id", "product", "produs_id"),
    ("product_standard", "standard_id", "standard", "standard_id"),
    ("stock", "produs_id", "product", "produs_id"),
    ("stock", "depozit_id", "warehouse", "depozit_id"),
    ("sales_order", "client_id", "customer", "client_id"),
    ("order_line", "cv_id", "sales_order", "cv_id"),
    ("order_line", "produs_id", "product", "produs_id"),
    ("shipment", "cv_id", "sales_order", "cv_id"),
    ("shipment", "depozit_id", "warehouse", "depozit_id"),
    ("rma", "client_id", "customer", "client_id"),
    ("rma", "produs_id", "product", "produs_id"),
    ("rma", "cv_id", "sales_order", "cv_id"),
)
DOMAINS = (
    ("customer", "tip", ("B2B", "B2C")),
    ("product", "status", ("ACTIV", "INACTIV")),
)


class _Check(NamedTuple):
    """A constraint: which rows of its table have a key to count, and the key."""

    name: str
    table: str
    counts: Column
    key: Sequence[str]
    parent: tuple[str, str] | None = None
    is_domain: bool = False


def _checks(tables: dict[str, DataFrame]) -> list[_Check]:
    found = []
    for table, keys in UNIQUE_KEYS:
        # A key without any value names no row, so it cannot occur twice.
        present = reduce(or_, [F.col(k).isNotNull() for k in keys])
        found.append(_Check(f"unique {table}({', '.join(keys)})", table, present, keys))
    for child, foreign_key, parent, key in FOREIGN_KEYS:
        if parent in tables:
            name, referred = f"{child}.{foreign_key} in {parent}", F.col(foreign_key).isNotNull()
            found.append(_Check(name, child, referred, [foreign_key], (parent, key)))
    for table, column, allowed in DOMAINS:
        wrong = ~F.col(column).isin(*allowed)
        name = f"{table}.{column} in domain"
        found.append(_Check(name, table, wrong, [column], is_domain=True))
    return [check for check in found if check.table in tables]


def _whole(df: DataFrame, columns: Sequence[str]) -> bool:
    return all(isinstance(df.schema[c].dataType, T.IntegralType) for c in columns)


def _entry(number: int, key: Sequence[str], by_value: bool, as_parent: bool) -> Column:
    """A key as two longs: its values, where they are one or two whole numbers, else 128 hash bits."""
    if by_value:
        parts = [F.col(k).cast("long") for k in key]
    else:
        # Each value with its place, as nulls leave a hash as it was.
        texts = [F.col(k).cast("string") for k in key]
        told = [x for i, t in enumerate(texts) for x in (F.when(t.isNotNull(), F.lit(i)), t)]
        parts = [F.xxhash64(F.lit(seed), *told) for seed in (1, 2)]
    second = parts[1] if len(parts) > 1 else F.lit(0).cast("long")
    return F.struct(
        F.lit(number).alias("number"),
        parts[0].alias("a"),
        second.alias("b"),
        F.lit(as_parent).alias("as_parent"),
    )


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per constraint whose tables are present: violating keys and rows.

    Each table is read once, for the keys it has and for those that others refer to. Keys
    of all constraints meet in one aggregate, as two longs whatever they are made of and
    counted before the shuffle: a key is unique if it was counted once, and referred to
    rightly if its parent's table gave it too. No keys are joined.
    """
    checks = _checks(tables)
    spark = next(iter(tables.values())).sparkSession
    entries: dict[str, list[Column]] = {}
    for number, check in enumerate(checks):
        by_value = len(check.key) < 3 and _whole(tables[check.table], check.key)
        if check.parent:
            by_value = by_value and _whole(tables[check.parent[0]], [check.parent[1]])
            given = _entry(number, [check.parent[1]], by_value, True)
            named = F.when(F.col(check.parent[1]).isNotNull(), given)
            entries.setdefault(check.parent[0], []).append(named)
        own = _entry(number, check.key, by_value, False)
        entries.setdefault(check.table, []).append(F.when(check.counts, own))
    rows = None
    for table, listed in entries.items():
        # An entry that is null, as its row has no such key, is a row of nulls.
        found = tables[table].select(F.inline(F.array(*listed))).where("number IS NOT NULL")
        rows = found if rows is None else rows.unionByName(found)
    met = rows.groupBy("number", "a", "b").agg(
        F.count(F.when(~F.col("as_parent"), 1)).alias("cnt"),
        F.bool_or("as_parent").alias("there"),
    )
    referring = [i for i, c in enumerate(checks) if c.parent]
    valued = [i for i, c in enumerate(checks) if c.is_domain]
    violated = (
        F.when(F.col("number").isin(referring), ~F.col("there") & (F.col("cnt") > 0))
        .when(F.col("number").isin(valued), True)
        .otherwise(F.col("cnt") > 1)
    )
    totals = (
        met.where(violated)
        .groupBy("number")
        .agg(F.count("*").alias("keys"), F.sum("cnt").alias("rows"))
    )
    # One row per constraint, a fixed list.
    names = spark.createDataFrame(
        [(i, c.name) for i, c in enumerate(checks)], "number int, constraint_name string"
    )
    return names.join(totals, "number", "left").select(
        "constraint_name",
        F.coalesce("keys", F.lit(0)).alias("keys"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )
