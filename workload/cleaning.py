"""Column resolution, cleaning rules, dedup and unpivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import decode, text
from partloom.operators import columns, reshape
from partloom.plans.wide_catalog import assemble
from partloom.schemas import STANDARDS_MAP

from workload import binding as b
from workload import sql
from workload.registry import query

DIRTY_NAME = (
    "CASE p_type WHEN 'PROMO' THEN ' nan ' WHEN 'SMALL' THEN 'None' WHEN 'LARGE' THEN '   ' "
    "WHEN 'MEDIUM' THEN 'NAN' ELSE chr(9) || ' ' || p_name || ' ' || chr(10) END"
)
STRIPPED = "trim({}, ' ' || chr(9) || chr(10))"


@query(
    "clean_text",
    f"WITH t AS (SELECT p_partkey, {STRIPPED.format(DIRTY_NAME)} AS v FROM part) SELECT p_partkey, "
    "CASE WHEN v NOT IN ('', 'nan', 'None') THEN v END AS cleaned, "
    "v AS blanked, v NOT IN ('', 'nan', 'None') AS is_standard, "
    "lower(v) NOT IN ('', 'nan', 'none') AS is_link FROM t",
)
def clean_text(spark, sf_dir):
    value = F.expr(DIRTY_NAME)
    return b.read(spark, sf_dir, "part").select(
        "p_partkey",
        text.clean_text(value).alias("cleaned"),
        text.null_to_blank(value).alias("blanked"),
        text.is_standard_code(value).alias("is_standard"),
        text.is_link_code(value).alias("is_link"),
    )


SOCKET = (
    f"CASE p_type WHEN 'ECONOMY' THEN 'Socket LGA ' || CAST(1100 + p_size AS STRING) || ' (rev 2)' "
    f"WHEN 'LARGE' THEN 'am' || {b.SIZE} WHEN 'MEDIUM' THEN 'lga' || {b.SIZE} || '00-' || {b.SIZE} "
    "WHEN 'PROMO' THEN p_name || ' processor (old)/am5' "
    "WHEN 'SMALL' THEN 'cpu  socket (' || p_name || ')' ELSE p_name || '+' END"
)
SOCKET_WORDS = (
    "trim(regexp_replace(regexp_replace(replace(replace(replace(upper(raw), 'SOCKET', ' '), "
    r"'CPU', ' '), 'PROCESSOR', ' '), '\(.*?\)', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g'))"
)


@query(
    "normalize_socket",
    f"WITH s AS (SELECT p_partkey, {SOCKET} AS raw FROM part), "
    f"w AS (SELECT p_partkey, raw, {SOCKET_WORDS} AS v FROM s) SELECT p_partkey, raw, "
    r"CASE WHEN contains(v, 'AM5') THEN 'AM5' "
    r"WHEN regexp_matches(v, '\bLGA ?[0-9]{3,5}\b') "
    r"THEN 'LGA' || regexp_extract(v, '\bLGA ?([0-9]{3,5})\b', 1) "
    r"WHEN regexp_matches(v, '\bAM[2-5]\b') THEN 'AM' || regexp_extract(v, '\bAM([2-5])\b', 1) "
    "WHEN v <> '' THEN v END AS socket FROM w",
)
def normalize_socket(spark, sf_dir):
    raw = b.read(spark, sf_dir, "part").selectExpr("p_partkey", f"{SOCKET} AS raw")
    return raw.withColumn("socket", text.normalize_socket(F.col("raw")))


WARRANTY = (
    f"CASE p_type WHEN 'ECONOMY' THEN {b.SIZE} || '.9' WHEN 'LARGE' THEN 'abc' "
    f"WHEN 'PROMO' THEN ' ' || {b.SIZE} || ' ' WHEN 'SMALL' THEN {b.SIZE} || 'e1' "
    f"WHEN 'STANDARD' THEN {b.SIZE} || 'd' END"
)


@query(
    "warranty_default",
    f"SELECT p_partkey, CAST(trunc(coalesce(try_cast({WARRANTY} AS DOUBLE), 24)) AS INTEGER) "
    "AS garantie_luni FROM part",
)
def warranty_default(spark, sf_dir):
    months = text.warranty_months(F.expr(WARRANTY)).alias("garantie_luni")
    return b.read(spark, sf_dir, "part").select("p_partkey", months)


STATUS = (
    "CASE p_type WHEN 'ECONOMY' THEN 'ACTIV' WHEN 'LARGE' THEN ' INACTIV ' "
    "WHEN 'MEDIUM' THEN 'inactiv' WHEN 'PROMO' THEN 'RETIRED' WHEN 'SMALL' THEN '' END"
)


@query(
    "status_rule",
    f"SELECT p_partkey, CASE WHEN trim({STATUS}) IN ('ACTIV', 'INACTIV') THEN trim({STATUS}) "
    f"ELSE 'ACTIV' END AS status, CASE WHEN upper(trim({STATUS})) = 'INACTIV' THEN 'INACTIV' "
    "ELSE 'ACTIV' END AS status_any_case FROM part",
)
def status_rule(spark, sf_dir):
    status = F.expr(STATUS)
    return b.read(spark, sf_dir, "part").select(
        "p_partkey",
        text.status_or_default(status).alias("status"),
        text.status_or_default(status, ignore_case=True).alias("status_any_case"),
    )


BRAND = "CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN '' ELSE lower(p_brand) END"
NAME = "CASE p_type WHEN 'LARGE' THEN NULL ELSE ' ' || p_name || '  ' || p_brand END"
DERIVED_SKU = (
    f"upper(substr(coalesce({BRAND}, 'nan'), 1, 6)) || '-' || "
    f"upper(substr(regexp_replace(coalesce({NAME}, 'nan'), '\\s+', '-', 'g'), 1, 20))"
)


@query("derive_sku", f"SELECT p_partkey, {DERIVED_SKU} AS cod_sku FROM part")
def derive_sku(spark, sf_dir):
    sku = text.derive_sku(F.expr(BRAND), F.expr(NAME)).alias("cod_sku")
    return b.read(spark, sf_dir, "part").select("p_partkey", sku)


# A file with its own names for everything but the SKU, as SQL per column.
LISTING = {
    "Row": "CAST(p_partkey AS STRING)",
    "Title": "' ' || p_name",
    "MAKER": "p_brand",
    "CPU Socket": f"'am' || {b.SIZE}",
    "ram_type": f"CASE WHEN p_size > 25 THEN 'nan' ELSE {b.SECOND_WORD} END",
    "Board Form Factor": b.FIRST_WORD,
    "System Bus": f"'PCIe x' || {b.SIZE}",
    "M.2 Slots": f"CASE WHEN p_size > 25 THEN 'None' ELSE 'M.2 22' || {b.SIZE} END",
    "Type": "p_type",
}
# A file with a SKU, and no name, brand or category column.
STOCKLIST = {"Unnamed: 0": "p_name", "PN": f"{b.SIZE} || p_brand", "bus": "p_type"}


def _listing(spark, sf_dir, rank, spec):
    return b.read(spark, sf_dir, "part").selectExpr(
        *[f"{text} AS `{name}`" for name, text in spec.items()],
        f"{rank} AS source_rank",
        "'' AS source_file",
        "CAST(0 AS BIGINT) AS source_block",
        "p_partkey AS source_row",
    )


ORDER = ("source_rank", "source_file", "source_block", "source_row")
LISTING_SKU = "upper(substr(p_brand, 1, 6)) || '-' || " + (
    "upper(substr(regexp_replace(' ' || p_name, '\\s+', '-', 'g'), 1, 20))"
)


@query(
    "resolve_columns",
    f"SELECT p_partkey AS source_row, {LISTING_SKU} AS cod_sku, ' ' || p_name AS denumire, "
    f"p_type AS categorie, p_brand AS producator, {LISTING['CPU Socket']} AS socket, "
    f"{LISTING['ram_type']} AS memory_type, {LISTING['Board Form Factor']} AS form_factor, "
    f"{LISTING['System Bus']} AS interface, {LISTING['M.2 Slots']} AS storage_form FROM part",
)
def resolve_columns(spark, sf_dir):
    rows = _listing(spark, sf_dir, 0, LISTING)
    return columns.resolve_columns(rows, keep=ORDER).drop(*ORDER[:3])


@query(
    "resolve_columns_by_default",
    "SELECT p_partkey AS source_row, CAST(p_size AS STRING) || p_brand AS cod_sku, "
    "p_name AS denumire, 'RAM' AS categorie, '' AS producator, CAST(NULL AS STRING) AS socket, "
    "CAST(NULL AS STRING) AS memory_type, CAST(NULL AS STRING) AS form_factor, "
    "p_type AS interface, CAST(NULL AS STRING) AS storage_form FROM part",
)
def resolve_columns_by_default(spark, sf_dir):
    rows = _listing(spark, sf_dir, 0, STOCKLIST)
    return columns.resolve_columns(rows, "RAM", keep=ORDER).drop(*ORDER[:3])


WIDE_SQL = (
    f"WITH a AS (SELECT 0 AS r, p_partkey AS n, {LISTING_SKU} AS cod_sku, p_name AS denumire, "
    f"p_type AS categorie, p_brand AS producator, CASE WHEN p_size = 5 OR p_size >= 50 "
    f"THEN 'AM5' ELSE 'AM' || {b.SIZE} END AS socket, CASE WHEN p_size <= 25 "
    f"THEN {b.SECOND_WORD} END AS memory_type, {b.FIRST_WORD} AS form_factor, "
    f"'PCIe x' || {b.SIZE} AS interface, CASE WHEN p_size <= 25 THEN 'M.2 22' || {b.SIZE} END "
    "AS storage_form FROM part UNION ALL "
    f"SELECT 1, p_partkey, {b.SIZE} || p_brand, p_name, 'Unknown', NULL, NULL, NULL, NULL, "
    "p_type, NULL FROM part), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY cod_sku, denumire ORDER BY r, n) AS rn FROM a)"
    " SELECT cod_sku, denumire, categorie, producator, 24 AS garantie_luni, 'ACTIV' AS status, "
    "'Central' AS depozit, 'Bucuresti' AS oras_depozit, 'RO' AS tara_depozit, 10 AS cantitate, "
    "2 AS prag_minim, socket, memory_type, form_factor, interface, storage_form "
    "FROM k WHERE rn = 1"
)


def wide_catalog(spark, sf_dir):
    """Two unlike files made one clean wide catalogue, first of each SKU and name."""
    return assemble(
        [
            columns.resolve_columns(_listing(spark, sf_dir, 0, LISTING), keep=ORDER),
            columns.resolve_columns(_listing(spark, sf_dir, 1, STOCKLIST), keep=ORDER),
        ]
    )


@query("wide_catalog", WIDE_SQL)
def wide_catalog_columns(spark, sf_dir):
    return columns.wide_order(wide_catalog(spark, sf_dir))


@query(
    "catalog_union",
    "SELECT p_partkey AS id, p_name AS denumire, p_brand AS producator, NULL AS tara FROM part "
    "UNION ALL SELECT s_suppkey, NULL, s_name, n_name FROM supplier "
    "JOIN nation ON s_nationkey = n_nationkey",
)
def catalog_union(spark, sf_dir):
    parts = b.read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS denumire", "p_brand AS producator"
    )
    sites = b.warehouse(spark, sf_dir).selectExpr(
        "oras AS tara", "nume AS producator", "depozit_id AS id"
    )
    return reshape.union_by_name([parts, sites])


@query(
    "dedup_keep_first",
    "SELECT p_brand, p_name, p_partkey, p_type FROM part QUALIFY "
    "row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1",
)
def dedup_keep_first(spark, sf_dir):
    parts = b.read(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", "p_type")
    return reshape.keep_first(parts, ["p_brand", "p_name"], ["p_partkey"])


@query(
    "dedup_rows",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem",
)
def dedup_rows(spark, sf_dir):
    lines = b.read(spark, sf_dir, "lineitem")
    return lines.select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"
    ).dropDuplicates()


HOLES = (
    "p_partkey",
    "CASE WHEN p_type <> 'PROMO' THEN p_brand END AS producator",
    "CASE WHEN p_size > 25 THEN p_name END AS denumire",
)


@query(
    "drop_null_rows",
    f"WITH t AS (SELECT {', '.join(HOLES)} FROM part) SELECT 'any' AS rule, * FROM t "
    "WHERE producator IS NOT NULL AND denumire IS NOT NULL UNION ALL "
    "SELECT 'all', * FROM t WHERE producator IS NOT NULL OR denumire IS NOT NULL",
)
def drop_null_rows(spark, sf_dir):
    rows = b.read(spark, sf_dir, "part").selectExpr(*HOLES)
    frames = [
        reshape.drop_null_rows(rows, ["producator", "denumire"], rule).select(
            F.lit(rule).alias("rule"), *rows.columns
        )
        for rule in ("any", "all")
    ]
    return reshape.union_by_name(frames)


@query("standard_codes", sql.codes(b.SPARSE_CODES))
def standard_codes(spark, sf_dir):
    return reshape.standard_codes(b.wide_parts(spark, sf_dir, b.SPARSE_CODES), STANDARDS_MAP)


@query(
    "standard_links",
    f"SELECT 'P-' || CAST(produs_id AS STRING) AS cod_sku, grup, cod "
    f"FROM ({sql.links(b.SPARSE_CODES)})",
)
def standard_links(spark, sf_dir):
    return reshape.standard_links(b.wide_parts(spark, sf_dir, b.SPARSE_CODES), STANDARDS_MAP)


@query("distinct_names", "SELECT DISTINCT s_name AS nume FROM supplier")
def distinct_names(spark, sf_dir):
    return reshape.distinct_names(b.read(spark, sf_dir, "supplier"), "s_name").orderBy("nume")


@query(
    "json_props",
    "SELECT event_type, CAST(props ->> '$.k' AS BIGINT) AS k, count(*) AS cnt "
    "FROM events GROUP BY 1, 2",
)
def json_props(spark, sf_dir):
    """A JSON text column read by field."""
    record = F.parse_json("props")
    events = b.read(spark, sf_dir, "events").select(
        "event_type", F.try_variant_get(record, "$.k", "bigint").alias("k")
    )
    return events.groupBy("event_type", "k").agg(F.count("*").alias("cnt"))


# Doubles of many sizes: thirds and sevenths, whole, tiny and huge ones.
SIZES = (
    "CASE l_linenumber WHEN 1 THEN l_extendedprice / 7 WHEN 2 THEN l_quantity "
    "WHEN 3 THEN l_extendedprice * 1e30 WHEN 4 THEN l_extendedprice / 1e13 "
    "WHEN 5 THEN -l_extendedprice / 3e7 WHEN 6 THEN l_quantity * 1e18 ELSE 0 * l_quantity END"
)


@query(
    "number_text",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {SIZES} AS value, false AS exponent_inside "
    "FROM lineitem",
)
def number_text(spark, sf_dir):
    """Numbers written as text and read again are the same numbers."""
    value = F.expr(SIZES)
    written = decode.plain_number(value)
    inside = (F.abs(value) >= 1e-6) & (F.abs(value) < 1e21) & written.contains("e")
    return b.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        written.cast("double").alias("value"),
        inside.alias("exponent_inside"),
    )
