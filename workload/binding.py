"""Catalogue inputs derived from the driver's tables.

Expressions that both Spark and the check database evaluate are plain SQL text,
kept here once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import merge
from partloom.operators.joins import lookup
from partloom.operators.keys import assign_ids
from partloom.operators.reshape import distinct_names, standard_codes, standard_links
from partloom.schemas import STANDARDS_MAP
from partloom.session import small_tasks, stored

SKU = "'P-' || CAST(p_partkey AS STRING)"
SIZE = "CAST(p_size AS STRING)"
FIRST_WORD = "split_part(p_name, ' ', 1)"
SECOND_WORD = "split_part(p_name, ' ', 2)"

# A wide catalogue row per part. The sparse form has products without codes,
# and spells "no value" in more than one way.
CODES = {"socket": SIZE, "memory_type": SECOND_WORD, "form_factor": FIRST_WORD}
SPARSE_CODES = {
    "socket": f"CASE WHEN p_type <> 'PROMO' THEN {SIZE} END",
    "memory_type": (
        "CASE p_type WHEN 'PROMO' THEN ' ' WHEN 'SMALL' THEN 'NONE' WHEN 'LARGE' THEN 'nan' "
        f"ELSE ' ' || {SECOND_WORD} END"
    ),
    "form_factor": f"CASE p_type WHEN 'PROMO' THEN 'None' ELSE {FIRST_WORD} END",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def wide_parts(spark: SparkSession, sf_dir: str, codes: dict[str, str] = CODES) -> DataFrame:
    """One wide row per part, without stock columns."""
    return read(spark, sf_dir, "part").selectExpr(
        f"{SKU} AS cod_sku",
        "p_name AS denumire",
        "p_type AS categorie",
        "p_brand AS producator",
        "24 AS garantie_luni",
        "'ACTIV' AS status",
        "p_partkey AS source_row",
        *[f"{text} AS {name}" for name, text in codes.items()],
    )


def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide stock row per order line."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "'P-' || CAST(l_partkey AS STRING) AS cod_sku",
        "'S-' || CAST(l_suppkey AS STRING) AS depozit",
        "l_returnflag AS oras_depozit",
        "l_linestatus AS tara_depozit",
        "CAST(l_quantity AS BIGINT) AS cantitate",
        "CAST(l_linenumber AS BIGINT) AS prag_minim",
    )


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = distinct_names(read(spark, sf_dir, "part"), "p_type")
    return merge.table_rows(assign_ids(names, ["nume"], "categorie_id"), "category")


def manufacturer(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = distinct_names(read(spark, sf_dir, "part"), "p_brand")
    return merge.table_rows(assign_ids(names, ["nume"], "producator_id"), "manufacturer")


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = table(spark, sf_dir, "category").selectExpr("nume AS p_type", "categorie_id")
    makers = table(spark, sf_dir, "manufacturer").selectExpr("nume AS p_brand", "producator_id")
    parts = lookup(read(spark, sf_dir, "part"), categories, ["p_type"], "inner")
    return lookup(parts, makers, ["p_brand"], "inner").selectExpr(
        "p_partkey AS produs_id",
        f"{SKU} AS cod_sku",
        "p_name AS denumire",
        "categorie_id",
        "producator_id",
        "24 AS garantie_luni",
        "'ACTIV' AS status",
    )


def standard(spark: SparkSession, sf_dir: str, codes: dict[str, str] = CODES) -> DataFrame:
    found = standard_codes(wide_parts(spark, sf_dir, codes), STANDARDS_MAP)
    return merge.table_rows(assign_ids(found, ["grup", "cod"], "standard_id"), "standard")


def sparse_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark, sf_dir, SPARSE_CODES)


def _links(spark: SparkSession, sf_dir: str, codes: dict[str, str], standards: str) -> DataFrame:
    links = standard_links(
        wide_parts(spark, sf_dir, codes).withColumnRenamed("source_row", "produs_id"),
        STANDARDS_MAP,
        "produs_id",
    )
    known = table(spark, sf_dir, standards).select("grup", "cod", "standard_id")
    return lookup(links, known, ["grup", "cod"], "inner").select("produs_id", "standard_id")


def product_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, CODES, "standard")


def sparse_product_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, SPARSE_CODES, "sparse_standard")


def warehouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    suppliers = read(spark, sf_dir, "supplier")
    placed = suppliers.join(nation, suppliers.s_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return placed.selectExpr(
        "s_suppkey AS depozit_id", "s_name AS nume", "n_name AS oras", "r_name AS tara"
    )


def stock(
    spark: SparkSession, sf_dir: str, condition: str = "true", product: str = "l_partkey"
) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where(condition)
    return lines.groupBy(
        F.expr(product).alias("produs_id"), F.col("l_suppkey").alias("depozit_id")
    ).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("cantitate"),
        (F.max("l_linenumber").cast("bigint") * 5).alias("prag_minim"),
    )


TIP = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'B2B' WHEN 'BUILDING' THEN 'B2B' "
    "WHEN 'FURNITURE' THEN 'B2C' WHEN 'HOUSEHOLD' THEN 'B2C' ELSE c_mktsegment END"
)
OPTIONAL_ORDER = "CASE WHEN l_linestatus = 'F' THEN l_orderkey END"


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS client_id", f"{TIP} AS tip", "c_name AS nume"
    )


def sales_order(spark: SparkSession, sf_dir: str, key: str = "o_orderkey") -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        f"{key} AS cv_id",
        "o_custkey AS client_id",
        "o_orderdate AS data_creare",
        "o_orderstatus AS status",
    )


def order_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS cv_id",
        "l_linenumber AS linie_nr",
        "l_partkey AS produs_id",
        "CAST(l_quantity AS BIGINT) AS cantitate",
    )


def shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS cv_id", "l_suppkey AS depozit_id", "l_shipdate AS data_expediere"
    )


def rma(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
    return returned.join(orders, "l_orderkey", "left").selectExpr(
        "o_custkey AS client_id", "l_partkey AS produs_id", f"{OPTIONAL_ORDER} AS cv_id"
    )


# Catalogue tables, each derived from the driver's tables by one job.
DERIVED = {
    "manufacturer": manufacturer,
    "category": category,
    "standard": standard,
    "product": product,
    "product_standard": product_standard,
    "warehouse": warehouse,
    "stock": stock,
    "sparse_standard": sparse_standard,
    "sparse_product_standard": sparse_product_standard,
}
CATALOG = (
    "manufacturer",
    "category",
    "standard",
    "product",
    "product_standard",
    "warehouse",
    "stock",
)

_stored: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the driver's tables: other files are other tables."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(
        sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue table as users have it: stored.

    The first use in a session derives it from the driver's tables and writes
    it to the shared folder; the queries then read the written table, until the driver's
    files change.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name, _stamp(spark, sf_dir))
    if key not in _stored:
        rows = DERIVED[name](spark, sf_dir)
        with small_tasks(spark):
            _stored[key] = stored(rows.sortWithinPartitions(rows.columns[0]), name)
    return _stored[key]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named tables of the catalogue, all seven by default."""
    return {name: table(spark, sf_dir, name) for name in names or CATALOG}


def sparse_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Products and their standards, where some products have none."""
    return {
        "product": table(spark, sf_dir, "product"),
        "standard": table(spark, sf_dir, "sparse_standard"),
        "product_standard": table(spark, sf_dir, "sparse_product_standard"),
    }


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The catalogue and the sales tables that only constraints look at."""
    return {
        **tables(spark, sf_dir),
        "customer": customer(spark, sf_dir),
        "sales_order": sales_order(spark, sf_dir),
        "order_line": order_line(spark, sf_dir),
        "shipment": shipment(spark, sf_dir),
        "rma": rma(spark, sf_dir),
    }


# A labelled listing per part: type of the part, category, label and text.
PRICE = "'$' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"
SPEC_TEXTS = (
    ("ECONOMY", "memory", "Speed", f"'DDR' || {SIZE} || '-' || {SIZE} || '00'"),
    ("ECONOMY", "memory", "Modules", f"{SIZE} || ' x 16GB'"),
    ("ECONOMY", "memory", "Price / GB", f"'$' || {SIZE} || '.125'"),
    ("ECONOMY", "memory", "Color", f"CASE WHEN p_size > 25 THEN 'None' ELSE {FIRST_WORD} END"),
    ("ECONOMY", "memory", "CAS Latency", SIZE),
    (
        "LARGE",
        "internal-hard-drive",
        "Capacity",
        f"{SIZE} || CASE WHEN p_size > 40 THEN ' GB' WHEN p_size > 20 THEN ' TB' "
        "WHEN p_size > 10 THEN ' MB' ELSE '' END",
    ),
    (
        "LARGE",
        "internal-hard-drive",
        "Type",
        f"CASE WHEN p_size > 25 THEN 'SSD' ELSE {SIZE} || '00 RPM' END",
    ),
    (
        "LARGE",
        "internal-hard-drive",
        "Form Factor",
        f"CASE WHEN p_size > 25 THEN 'M.2-22' || {SIZE} ELSE {SIZE} || '.5\"' END",
    ),
    ("LARGE", "internal-hard-drive", "Cache", f"{SIZE} || ' MB'"),
    ("LARGE", "internal-hard-drive", "Interface", "p_name"),
    ("MEDIUM", "power-supply", "Type", FIRST_WORD),
    (
        "MEDIUM",
        "power-supply",
        "Efficiency Rating",
        f"CASE WHEN p_size > 25 THEN '80+ ' || upper({SECOND_WORD}) ELSE '80+' END",
    ),
    ("MEDIUM", "power-supply", "Wattage", f"{SIZE} || '0 W'"),
    ("MEDIUM", "power-supply", "Modular", "CASE WHEN p_size > 25 THEN 'No' ELSE 'Full' END"),
    ("PROMO", "webcam", "Resolution", f"'4k, ' || {SIZE} || 'p'"),
    ("PROMO", "webcam", "Connection", "p_name"),
    ("PROMO", "webcam", "Focus Type", "'  '"),
    (
        "PROMO",
        "webcam",
        "Operating System",
        "CASE WHEN p_size > 25 THEN 'Windows' ELSE 'Windows, OS X, ChromeOS' END",
    ),
    ("PROMO", "webcam", "FOV Angle", f"{SIZE} || '.5 deg'"),
    ("SMALL", "case-fan", "Size", f"{SIZE} || ' mm'"),
    ("SMALL", "case-fan", "RPM", f"{SIZE} || ' - ' || {SIZE} || '0 RPM'"),
    ("SMALL", "case-fan", "Airflow", "'1..2'"),
    ("SMALL", "case-fan", "Noise Level", "'n/a'"),
    ("SMALL", "case-fan", "PWM", "CASE WHEN p_size > 25 THEN 'Yes' ELSE 'NO' END"),
    ("SMALL", "case-fan", "Color", FIRST_WORD),
    ("STANDARD", "cpu", "Core Count", SIZE),
    ("STANDARD", "cpu", "TDP", f"{SIZE} || ' W'"),
    ("STANDARD", "cpu", "Integrated Graphics", "CASE WHEN p_size > 25 THEN 'None' ELSE p_name END"),
    ("STANDARD", "cpu", "SMT", "CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END"),
)
UNKNOWN_LABEL = ("PROMO", "webcam", "Shipping Weight", SIZE)


def raw_specs(spark: SparkSession, sf_dir: str, texts=SPEC_TEXTS) -> DataFrame:
    """One row per labelled text of a part, from one scan of the parts."""
    by_type: dict[str, list[str]] = {}
    categories = {}
    for position, (p_type, name, label, text) in enumerate(texts):
        entry = f"named_struct('position', {position}, 'label', '{label}', 'value', {text})"
        by_type.setdefault(p_type, []).append(entry)
        categories[p_type] = name
    entries = " ".join(f"WHEN '{t}' THEN array({', '.join(e)})" for t, e in by_type.items())
    names = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in categories.items())
    listed = read(spark, sf_dir, "part").selectExpr(
        f"CASE p_type {names} END AS category",
        "p_partkey AS item_id",
        "p_name AS name",
        f"{PRICE} AS price_text",
        f"explode(CASE p_type {entries} END) AS entry",
    )
    return listed.select("category", "item_id", "name", "price_text", "entry.*")


def raw_specs_sql(texts=SPEC_TEXTS) -> str:
    selects = [
        f"SELECT '{name}' AS category, p_partkey AS item_id, p_name AS name, "
        f"{PRICE} AS price_text, {position} AS position, '{label}' AS label, {text} AS value "
        f"FROM part WHERE p_type = '{p_type}'"
        for position, (p_type, name, label, text) in enumerate(texts)
    ]
    return " UNION ALL ".join(selects)
