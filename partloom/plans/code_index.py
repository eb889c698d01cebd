"""A stored index from codes to products, for the queries that look for a shared code.

One row per link, with the names its queries show, in a folder per standard group and
sorted by the upper-case code. A filter for codes is compared with the statistics of
files and row groups as it stands, with no function over a column in its way. Rows of one
code are also sorted by category and product and dealt by range, so a code that very many
products share lies in several files, which as many tasks read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators.joins import having, lookup

INDEX_DDL = (
    "code string, category_key string, produs_id long, cod_sku string, denumire string, "
    "grup string, cod string, categorie string, group_key string"
)
_ORDER = ["group_key", "code", "category_key", "produs_id"]
# Codes of one product up to this many are looked up by value, more by a join.
LISTED_CODES = 1000


def write_code_index(
    tables: Mapping[str, DataFrame], path: str, files: int | None = None
) -> DataFrame:
    """Write the index of a catalogue; returns it as read back.

    ``files`` is the number of ranges that rows are dealt to, by default Spark's own.
    """
    standards = tables["standard"].select("standard_id", "grup", "cod")
    categories = tables["category"].select("categorie_id", F.col("nume").alias("categorie"))
    products = tables["product"].select("produs_id", "cod_sku", "denumire", "categorie_id")
    named = lookup(products, categories, ["categorie_id"], "inner")
    links = lookup(tables["product_standard"], standards, ["standard_id"], "inner")
    rows = links.join(named, "produs_id").select(
        F.upper("cod").alias("code"),
        F.upper("categorie").alias("category_key"),
        "produs_id",
        "cod_sku",
        "denumire",
        "grup",
        "cod",
        "categorie",
        F.upper("grup").alias("group_key"),
    )
    ranged = rows.repartitionByRange(*([files] if files else []), *_ORDER)
    ranged.sortWithinPartitions(*_ORDER).write.partitionBy("group_key").parquet(path)
    return read_code_index(rows.sparkSession, path)


def read_code_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_DDL).parquet(path)


def compatible(
    index: DataFrame,
    tables: Mapping[str, DataFrame],
    source_sku: str,
    group: str,
    categories: Sequence[str],
) -> DataFrame:
    """Products of the categories that share a code of ``group`` with a product.

    As the query of this name over the tables, from the index: a product appears once per
    code it shares, in no order; comparison ignores case.
    """
    source = tables["product"].where(F.col("cod_sku") == source_sku)
    source = having(source, tables["category"], ["categorie_id"]).select("produs_id")
    linked = having(tables["product_standard"], source, ["produs_id"])
    in_group = tables["standard"].where(F.upper("grup") == group)
    codes = having(in_group, linked, ["standard_id"]).select(F.upper("cod").alias("code")).distinct()
    wanted = index.where(
        (F.col("group_key") == group) & F.col("category_key").isin(*categories)
    )
    listed = [row.code for row in codes.limit(LISTED_CODES + 1).collect()]
    if len(listed) <= LISTED_CODES:
        found = wanted.where(F.col("code").isin(listed))
    else:
        found = having(wanted, codes, ["code"])
    return found.select("cod_sku", "denumire")


def codes_per_category(index: DataFrame, group: str) -> DataFrame:
    """Products per category and code of a group, with no join."""
    rows = index.where((F.col("group_key") == F.upper(F.lit(group))) & (F.col("grup") == group))
    counted = rows.groupBy("categorie", F.col("cod").alias("socket")).agg(
        F.count("*").alias("nr")
    )
    return counted.orderBy(F.asc_nulls_last("categorie"), F.asc_nulls_last("socket"))
