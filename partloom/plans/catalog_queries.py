"""The catalogue queries, over a dict of tables named as in ``schemas``.

Facts are counted or summed by id before names are joined, so a category or
standard that holds most rows is one row per task by the time of the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators.checks import duplicates
from partloom.operators.joins import having, lacking
from partloom.schemas import SQL_NAMES

Tables = Mapping[str, DataFrame]

# Standard groups and the category names each query looks for.
SOCKET_GROUP = "SOCKET_CPU"
MEMORY_GROUP = "MEM_TYPE"
BOARD_FORM_GROUP = "FORM_FACTOR_MB"
BOARD_CATEGORIES = ("MOTHERBOARD", "MOBO", "MAINBOARD")
MEMORY_CATEGORIES = ("RAM",)
CASE_CATEGORIES = ("CASE",)


def products_per_category(tables: Tables) -> DataFrame:
    counted = tables["product"].groupBy("categorie_id").agg(F.count("*").alias("n"))
    named = counted.join(tables["category"], "categorie_id")
    totals = named.groupBy(F.col("nume").alias("categorie")).agg(F.sum("n").alias("produse"))
    return totals.orderBy(F.desc("produse"), "categorie")


def standards_per_group(tables: Tables) -> DataFrame:
    groups = tables["standard"].groupBy(F.trim("grup").alias("grup"))
    return groups.agg(F.count("*").alias("nr_standard")).orderBy(F.asc_nulls_last("grup"))


def links_per_group(tables: Tables) -> DataFrame:
    counted = tables["product_standard"].groupBy("standard_id").agg(F.count("*").alias("n"))
    named = counted.join(tables["standard"], "standard_id")
    totals = named.groupBy(F.trim("grup").alias("grup")).agg(F.sum("n").alias("nr_legaturi"))
    return totals.orderBy(F.asc_nulls_last("grup"))


def compatible(
    tables: Tables, source_sku: str, group: str, categories: Sequence[str]
) -> DataFrame:
    """Products of the categories that share a code of ``group`` with a product.

    A product appears once per code it shares, in no order; comparison ignores case.
    """
    in_group = tables["standard"].where(F.upper("grup") == group)
    coded = in_group.select("standard_id", F.upper("cod").alias("code"))
    wanted = tables["category"].where(F.upper("nume").isin(*categories)).select("categorie_id")

    source = tables["product"].where(F.col("cod_sku") == source_sku)
    source = having(source, tables["category"], ["categorie_id"]).select("produs_id")
    source_links = having(tables["product_standard"], source, ["produs_id"])
    codes = source_links.join(coded, "standard_id").select("code")

    matching = having(coded, codes, ["code"]).select("standard_id")
    links = tables["product_standard"].join(matching, "standard_id").select("produs_id")
    targets = having(tables["product"], wanted, ["categorie_id"])
    found = links.join(targets.select("produs_id", "cod_sku", "denumire"), "produs_id")
    return found.select("cod_sku", "denumire")


def compatible_boards(tables: Tables, cpu_sku: str) -> DataFrame:
    found = compatible(tables, cpu_sku, SOCKET_GROUP, BOARD_CATEGORIES)
    # The SKU lets the sort split a name that very many products share.
    return found.orderBy(F.asc_nulls_last("denumire"), "cod_sku")


def compatible_memory(tables: Tables, board_sku: str) -> DataFrame:
    return compatible(tables, board_sku, MEMORY_GROUP, MEMORY_CATEGORIES)


def compatible_cases(tables: Tables, board_sku: str) -> DataFrame:
    return compatible(tables, board_sku, BOARD_FORM_GROUP, CASE_CATEGORIES)


def stock_per_category(tables: Tables) -> DataFrame:
    per_product = tables["stock"].groupBy("produs_id").agg(F.sum("cantitate").alias("q"))
    placed = per_product.join(tables["product"].select("produs_id", "categorie_id"), "produs_id")
    per_category = placed.groupBy("categorie_id").agg(F.sum("q").alias("q"))
    named = per_category.join(tables["category"], "categorie_id")
    return named.groupBy(F.col("nume").alias("categorie")).agg(
        F.sum("q").alias("total_cantitate")
    )


def largest_stock(tables: Tables) -> DataFrame:
    return stock_per_category(tables).orderBy(F.desc_nulls_first("total_cantitate"), "categorie")


def critical_stock(tables: Tables) -> DataFrame:
    low = tables["stock"].where(F.col("cantitate") < F.col("prag_minim"))
    sites = tables["warehouse"].select("depozit_id", F.col("nume").alias("depozit"))
    named = low.join(sites, "depozit_id").join(
        tables["product"].select("produs_id", "denumire"), "produs_id"
    )
    return named.select("denumire", "depozit", "cantitate", "prag_minim")


def products_without_stock(tables: Tables) -> DataFrame:
    return lacking(tables["product"], tables["stock"], ["produs_id"]).select("cod_sku", "denumire")


def duplicate_skus(tables: Tables) -> DataFrame:
    return duplicates(tables["product"], ["cod_sku"])


def products_without_standard(tables: Tables) -> DataFrame:
    bare = lacking(tables["product"], tables["product_standard"], ["produs_id"])
    return bare.agg(F.count("*").alias("produse_fara_standard"))


def codes_per_category(tables: Tables, group: str = SOCKET_GROUP) -> DataFrame:
    standards = tables["standard"].where(F.col("grup") == group).select("standard_id", "cod")
    placed = (
        tables["product_standard"]
        .join(standards, "standard_id")
        .join(tables["product"].select("produs_id", "categorie_id"), "produs_id")
    )
    counted = placed.groupBy("categorie_id", F.col("cod").alias("socket")).agg(
        F.count("*").alias("n")
    )
    named = counted.join(tables["category"], "categorie_id")
    totals = named.groupBy(F.col("nume").alias("categorie"), "socket").agg(F.sum("n").alias("nr"))
    return totals.orderBy(F.asc_nulls_last("categorie"), F.asc_nulls_last("socket"))


def _listing(grup: Column, cod: Column) -> Column:
    return F.concat(F.coalesce(grup, F.lit("")), F.lit(":"), F.coalesce(cod, F.lit("")))


def product_standards(tables: Tables) -> DataFrame:
    """Every product with its standards as one text, ``:`` when it has none.

    Links of a product are reduced to distinct standards as they are gathered,
    so a list is never longer than the standard table.
    """
    coded = tables["product_standard"].join(
        tables["standard"].select("standard_id", "grup", "cod"), "standard_id", "left"
    )
    entry = F.struct(
        F.col("grup").isNull().alias("no_grup"),
        "grup",
        F.col("cod").isNull().alias("no_cod"),
        "cod",
        "standard_id",
    )
    listed = coded.groupBy("produs_id").agg(F.array_sort(F.collect_set(entry)).alias("entries"))
    texts = F.transform("entries", lambda e: _listing(e["grup"], e["cod"]))
    return (
        tables["product"]
        .select("produs_id", "cod_sku", "denumire")
        .join(listed, "produs_id", "left")
        .select(
            "produs_id",
            "cod_sku",
            "denumire",
            F.coalesce(F.array_join(texts, ", "), F.lit(":")).alias("standarde"),
        )
    )


def table_counts(tables: Tables) -> DataFrame:
    """Row count of every table."""
    counts = [
        frame.agg(F.count("*").alias("cnt")).select(F.lit(SQL_NAMES[name]).alias("tabel"), "cnt")
        for name, frame in tables.items()
    ]
    combined, *others = counts
    for other in others:
        combined = combined.unionByName(other)
    return combined


# Names of the catalogue views.
VIEWS = {
    "vw_stoc_critic": critical_stock,
    "vw_produs_standarde": product_standards,
    "vw_stoc_pe_categorie": stock_per_category,
}


def create_views(spark: SparkSession, tables: Tables) -> None:
    """Create or replace temporary views for all tables and the named queries."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(SQL_NAMES[name])
    for name, query in VIEWS.items():
        query(tables).createOrReplaceTempView(name)
