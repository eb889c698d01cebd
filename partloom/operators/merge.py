"""Insert-if-absent loads: each operator returns the rows a table still lacks.

Existing rows are never changed, so running a load twice adds nothing the
second time. The new table is the union of the old one and the new rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.functions import text
from partloom.operators.joins import having, lacking, lookup
from partloom.operators.keys import LARGE_DIGITS, assign_ids
from partloom.operators.reshape import keep_first
from partloom.schemas import TABLE_DDL
from partloom.session import stored

_NO_SKU = "\x1f"

WIDE_TEXTS = (
    "categorie",
    "producator",
    "status",
    "depozit",
    "oras_depozit",
    "tara_depozit",
    "denumire",
    "cod_sku",
)
STOCK_KEYS = ("cod_sku", "depozit", "oras_depozit", "tara_depozit")


def table_rows(df: DataFrame, table: str) -> DataFrame:
    """Project onto the fixed schema of a table, null where a column is absent."""
    fields = [field.split(" ", 1) for field in TABLE_DDL[table].split(", ")]
    have = set(df.columns)
    return df.select(
        *[(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in fields]
    )


def clean_wide(wide: DataFrame) -> DataFrame:
    """Blank instead of null texts, whole warranty months, status in its domain.

    Without a warranty or status column every row takes the default.
    """
    absent = [c for c in ("garantie_luni", "status") if c not in wide.columns]
    wide = wide.withColumns({c: F.lit(None).cast("string") for c in absent})
    cleaned = wide.withColumns(
        {c: text.null_to_blank(F.col(c)) for c in WIDE_TEXTS if c in wide.columns}
    )
    return cleaned.withColumns(
        {
            "garantie_luni": text.warranty_months(F.col("garantie_luni")),
            "status": text.status_or_default(F.col("status")),
        }
    )


Taken = DataFrame | int | None


def new_named(
    current: DataFrame,
    names: DataFrame,
    table: str,
    id_column: str,
    keys: Sequence[str],
    taken: Taken = None,
) -> DataFrame:
    """Dimension rows whose natural key the table lacks, with fresh ids.

    New ids lie above those of ``taken``, a frame of ids or the highest one; by default
    those of ``current``.
    """
    absent = lacking(names, current, keys)
    above = current if taken is None else taken
    return table_rows(assign_ids(absent, keys, id_column, taken=above), table)


def new_manufacturers(current: DataFrame, names: DataFrame, taken: Taken = None) -> DataFrame:
    return new_named(current, names, "manufacturer", "producator_id", ["nume"], taken)


def new_categories(current: DataFrame, names: DataFrame, taken: Taken = None) -> DataFrame:
    return new_named(current, names, "category", "categorie_id", ["nume"], taken)


def new_standards(current: DataFrame, codes: DataFrame, taken: Taken = None) -> DataFrame:
    return new_named(current, codes, "standard", "standard_id", ["grup", "cod"], taken)


def wide_warehouses(wide: DataFrame) -> DataFrame:
    """Distinct warehouses of the wide catalogue; a blank name names none."""
    sites = wide.select(
        F.col("depozit").alias("nume"),
        F.col("oras_depozit").alias("oras"),
        F.col("tara_depozit").alias("tara"),
    ).na.drop(how="all")
    return sites.where(text.strip(F.col("nume")) != "").distinct()


def new_warehouses(current: DataFrame, sites: DataFrame, taken: Taken = None) -> DataFrame:
    """Warehouses the table lacks by name, city and country; blanks compare equal."""
    keys = ["nume", "oras", "tara"]
    blanked = {k: F.coalesce(F.col(k), F.lit("")) for k in keys}
    absent = lacking(sites.withColumns(blanked), current.withColumns(blanked), keys)
    stored = assign_ids(absent, keys, "depozit_id", taken=current if taken is None else taken)
    return table_rows(
        stored.withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in keys}), "warehouse"
    )


def product_key(sku: Column, name: Column) -> Column:
    """What tells products apart: the SKU, or the name where there is none."""
    unnamed = F.concat(F.lit(_NO_SKU), F.coalesce(name, F.lit("")))
    return F.coalesce(text.blank_to_null(sku), unnamed)


def new_products(
    current: DataFrame,
    wide: DataFrame,
    category: DataFrame,
    manufacturer: DataFrame,
    order: Sequence[str],
    taken: Taken = None,
) -> DataFrame:
    """Products whose SKU the table lacks; the first row of a SKU wins.

    ``current`` must hold the table's rows of the SKUs at hand; new ids lie above those of
    ``taken``, by default the ids in ``current``.
    """
    keyed = wide.withColumn("_key", product_key(F.col("cod_sku"), F.col("denumire")))
    columns = ["denumire", "cod_sku", "categorie", "producator", "garantie_luni", "status"]
    needed = dict.fromkeys(["_key", *columns, *order])
    first = keep_first(keyed.select(*needed), ["_key"], order)
    known = current.select(product_key(F.col("cod_sku"), F.col("denumire")).alias("_key"))
    absent = lacking(first, known, ["_key"])
    categories = category.select(F.col("nume").alias("categorie"), "categorie_id")
    makers = manufacturer.select(F.col("nume").alias("producator"), "producator_id")
    resolved = lookup(lookup(absent, categories, ["categorie"]), makers, ["producator"])
    above = current if taken is None else taken
    numbered = assign_ids(resolved, ["_key"], "produs_id", taken=above, digits=LARGE_DIGITS)
    return table_rows(
        numbered.withColumn("cod_sku", text.blank_to_null(F.col("cod_sku"))), "product"
    )


def new_links(
    current: DataFrame, links: DataFrame, product: DataFrame, standard: DataFrame
) -> DataFrame:
    """Product-standard pairs the bridge lacks, resolved from (cod_sku, grup, cod)."""
    standards = standard.select("grup", "cod", "standard_id")
    coded = lookup(links, standards, ["grup", "cod"], "inner").select("cod_sku", "standard_id")
    pairs = coded.join(product.select("cod_sku", "produs_id"), "cod_sku")
    return table_rows(lacking(pairs, current, ["produs_id", "standard_id"]), "product_standard")


def stock_rollup(wide: DataFrame) -> DataFrame:
    """Quantity summed and threshold maximal per SKU and warehouse.

    Fractions are summed as they are; only the total is cut to a whole number. Sums are of
    whole numbers or decimals, so they have every digit and are the same in whatever order
    tasks add up: such columns keep their type, texts and doubles are read to twelve
    places. What is no number, or has more than 26 digits before the point, counts as
    missing.
    """
    present = wide.na.drop(how="any", subset=["cod_sku", "depozit"])

    def exact(column: str) -> Column:
        kind = wide.schema[column].dataType
        if isinstance(kind, T.DecimalType):
            return F.col(column)
        if isinstance(kind, T.IntegralType):
            return F.col(column).cast("bigint")
        return F.col(column).try_cast("decimal(38,12)")

    quantity = F.coalesce(F.sum(exact("cantitate")).cast("bigint"), F.lit(0).cast("bigint"))
    threshold = F.max(exact("prag_minim")).cast("bigint")
    return present.groupBy(*STOCK_KEYS).agg(
        quantity.alias("cantitate"), threshold.alias("prag_minim")
    )


def new_stock(
    current: DataFrame, rolled: DataFrame, product: DataFrame, warehouse: DataFrame
) -> DataFrame:
    """Stock rows the table lacks; the quantity of an existing row is kept."""
    sites = warehouse.select(
        "depozit_id",
        F.col("nume").alias("depozit"),
        F.coalesce("oras", F.lit("")).alias("oras_depozit"),
        F.coalesce("tara", F.lit("")).alias("tara_depozit"),
    )
    placed = lookup(rolled, sites, ["depozit", "oras_depozit", "tara_depozit"], "inner")
    matched = placed.select("cod_sku", "depozit_id", "cantitate", "prag_minim").join(
        product.select("cod_sku", "produs_id"), "cod_sku"
    )
    return table_rows(lacking(matched, current, ["produs_id", "depozit_id"]), "stock")


def opening_stock(
    product: DataFrame,
    warehouse: DataFrame,
    name: str,
    city: str,
    country: str,
    quantity: int,
    threshold: int,
) -> DataFrame:
    """The same stock row for every product, in the one warehouse named."""
    site = warehouse.where(
        (F.col("nume") == name) & (F.col("oras") == city) & (F.col("tara") == country)
    )
    rows = product.select(
        "produs_id",
        site.select("depozit_id").scalar().alias("depozit_id"),
        F.lit(quantity).alias("cantitate"),
        F.lit(threshold).alias("prag_minim"),
    )
    return table_rows(rows.where(F.col("depozit_id").isNotNull()), "stock")


def register_product(
    tables: dict[str, DataFrame], product: DataFrame, links: DataFrame, stock: DataFrame
) -> dict[str, DataFrame]:
    """Catalogue with products, links and stock given by names instead of ids.

    ``product`` has cod_sku, denumire, categorie, producator, garantie_luni and
    status; ``links`` has cod_sku, grup, cod; ``stock`` has cod_sku, depozit,
    oras_depozit, tara_depozit, cantitate, prag_minim.
    """
    merged = dict(tables)

    def add(table: str, rows: DataFrame) -> None:
        # New ids are used by the steps that follow, so they are written first.
        merged[table] = tables[table].unionByName(stored(rows, table))

    add(
        "product",
        new_products(
            tables["product"], product, tables["category"], tables["manufacturer"], ["denumire"]
        ),
    )
    added = having(merged["product"], product, ["cod_sku"])
    add("product_standard", new_links(tables["product_standard"], links, added, tables["standard"]))
    add("stock", new_stock(tables["stock"], stock_rollup(stock), added, tables["warehouse"]))
    return merged
