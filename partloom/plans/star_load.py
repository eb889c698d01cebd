"""Wide catalogue to dimensions, products, links and stock."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import is_standard_code, strip
from partloom.operators import merge
from partloom.operators.joins import having
from partloom.operators.reshape import distinct_names, mapped_columns, standard_links
from partloom.schemas import STANDARDS_MAP
from partloom.session import stored
from partloom.sources.csv_files import ORDER_COLUMNS
from partloom.sources.store import CatalogStore

# Columns of the wide catalogue that make stock.
STOCK_COLUMNS = {"depozit", "oras_depozit", "tara_depozit", "cantitate", "prag_minim"}


class LoadReport(NamedTuple):
    """Version a load made, and how many rows it added to each table."""

    version: int
    added: dict[str, int]


def dimension_keys(rows: DataFrame, standards_map: Mapping[str, str]) -> DataFrame:
    """Distinct (kind, a, b, c): makers, categories, sites and standard codes of a wide catalogue.

    All come from one scan: each task reduces the keys of its own rows, and only
    distinct ones are shuffled.
    """

    def entry(kind: str, *columns: Column) -> Column:
        parts = [*columns, *[F.lit(None)] * (3 - len(columns))]
        named = [part.cast("string").alias(name) for part, name in zip(parts, "abc")]
        return F.struct(F.lit(kind).alias("kind"), *named)

    columns = mapped_columns(rows, standards_map)
    codes = [
        F.when(is_standard_code(code), entry("code", F.lit(group), code))
        for group, code in ((g, strip(F.col(raw).cast("string"))) for raw, g in columns.items())
    ]
    entries = [
        entry("maker", F.col("producator")),
        entry("category", F.col("categorie")),
        entry("site", F.col("depozit"), F.col("oras_depozit"), F.col("tara_depozit")),
        *codes,
    ]
    return rows.select(F.inline(F.array(*entries))).where("kind IS NOT NULL").distinct()


def load(
    store: CatalogStore,
    wide: DataFrame,
    standards_map: Mapping[str, str] = STANDARDS_MAP,
    order: Sequence[str] = ORDER_COLUMNS,
) -> LoadReport:
    """Add what the store lacks of a wide catalogue.

    The keys of all dimensions are gathered in one scan. Each step reads back what the
    steps before it wrote, dimensions first, so ids are read and never computed twice; steps that do not need each other
    run at the same time. Loading the same rows again adds nothing.
    """
    rows = merge.clean_wide(wide)
    run = store.begin()
    added: dict[str, int] = {}

    def write(steps: Mapping[str, Callable[[], DataFrame]]) -> None:
        def append(table: str) -> None:
            added[table] = store.append(run, table, steps[table]())

        with ThreadPoolExecutor(len(steps)) as pool:
            list(pool.map(append, steps))

    def written(table: str) -> DataFrame:
        return store.read(table, pending=run)

    keys = stored(dimension_keys(rows, standards_map), "dimensions")

    def named(kind: str, *columns: str) -> DataFrame:
        parts = [F.col(part).alias(name) for part, name in zip("abc", columns)]
        return keys.where(F.col("kind") == kind).select(*parts)

    write(
        {
            "manufacturer": lambda: merge.new_manufacturers(
                store.read("manufacturer"),
                distinct_names(named("maker", "nume"), "nume"),
                store.highest("manufacturer"),
            ),
            "category": lambda: merge.new_categories(
                store.read("category"),
                distinct_names(named("category", "nume"), "nume"),
                store.highest("category"),
            ),
            "standard": lambda: merge.new_standards(
                store.read("standard"), named("code", "grup", "cod"), store.highest("standard")
            ),
            "warehouse": lambda: merge.new_warehouses(
                store.read("warehouse"),
                merge.wide_warehouses(named("site", "depozit", "oras_depozit", "tara_depozit")),
                store.highest("warehouse"),
            ),
        }
    )
    skus = rows.select("cod_sku", "denumire")
    write(
        {
            "product": lambda: merge.new_products(
                store.holding("product", skus),
                rows,
                written("category"),
                written("manufacturer"),
                order,
                taken=store.highest("product"),
            )
        }
    )
    product = store.holding("product", skus, pending=run)
    ids = having(product, rows, ["cod_sku"]).select("produs_id")
    write(
        {
            "product_standard": lambda: merge.new_links(
                store.holding("product_standard", ids),
                standard_links(rows, standards_map),
                product,
                written("standard"),
            ),
            "stock": lambda: _new_stock(
                store.holding("stock", ids), rows, product, written("warehouse")
            ),
        }
    )
    return LoadReport(store.commit(run), added)


def register(
    store: CatalogStore, product: DataFrame, links: DataFrame, stock: DataFrame
) -> LoadReport:
    """Commit products, links and stock given by names, in the form of ``register_product``."""
    run = store.begin()
    named = {t: store.read(t) for t in ("manufacturer", "category", "standard", "warehouse")}
    added: dict[str, int] = {}

    def add(table: str, rows: DataFrame) -> None:
        added[table] = store.append(run, table, rows)

    known = merge.new_products(
        store.holding("product", product),
        product,
        named["category"],
        named["manufacturer"],
        ["denumire"],
        taken=store.highest("product"),
    )
    add("product", known)
    registered = having(store.holding("product", product, pending=run), product, ["cod_sku"])
    held = store.holding("product_standard", registered)
    add("product_standard", merge.new_links(held, links, registered, named["standard"]))
    rolled = merge.stock_rollup(stock)
    held = store.holding("stock", registered)
    add("stock", merge.new_stock(held, rolled, registered, named["warehouse"]))
    for table, rows in named.items():
        added[table] = store.append(run, table, rows.limit(0))
    return LoadReport(store.commit(run), added)


def _new_stock(
    current: DataFrame, rows: DataFrame, product: DataFrame, warehouse: DataFrame
) -> DataFrame:
    if not STOCK_COLUMNS <= set(rows.columns):
        return current.limit(0)
    return merge.new_stock(current, merge.stock_rollup(rows), product, warehouse)
