"""Dimensions, ids, insert-if-absent merges and whole loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import merge
from partloom.operators.keys import assign_ids
from partloom.plans import catalog_queries as q
from partloom.plans import seed, star_load
from partloom.plans.wide_catalog import export_wide_csv, read_wide_csv
from partloom.session import scratch_path
from partloom.sources.store import LOADED_TABLES, CatalogStore

from workload import binding as b
from workload import sql
from workload.cleaning import ORDER, WIDE_SQL, wide_catalog
from workload.registry import SQL, query


def _highest(rows: str, id_column: str) -> str:
    return f"(SELECT coalesce(max({id_column}), 0) FROM ({rows}))"


def _merged(old: str, incoming: str, keys: list[str], id_column: str) -> str:
    """Old rows, and incoming rows with a key that is not among them."""
    same = " AND ".join(f"o.{k} IS NOT DISTINCT FROM i.{k}" for k in keys)
    absent = f"SELECT * FROM ({incoming}) i WHERE NOT EXISTS (SELECT 1 FROM ({old}) o WHERE {same})"
    columns = ", ".join([id_column, *keys])
    new = sql.numbered(absent, keys, id_column, _highest(old, id_column))
    return f"SELECT {columns} FROM ({old}) UNION ALL SELECT {columns} FROM ({new})"


@query(
    "dim_category",
    f"SELECT categorie_id, nume, {sql.NO_TEXT} AS descriere FROM ({sql.CATEGORY})",
)
def dim_category(spark, sf_dir):
    return b.category(spark, sf_dir)


@query(
    "dim_manufacturer",
    f"SELECT producator_id, nume, {sql.NO_TEXT} AS tara, {sql.NO_TEXT} AS website "
    f"FROM ({sql.MANUFACTURER})",
)
def dim_manufacturer(spark, sf_dir):
    return b.manufacturer(spark, sf_dir)


@query(
    "dim_standard",
    f"SELECT standard_id, grup, cod, {sql.NO_TEXT} AS descriere FROM ({sql.STANDARD})",
)
def dim_standard(spark, sf_dir):
    return b.standard(spark, sf_dir)


SITES = f"SELECT nume, oras, tara FROM ({sql.WAREHOUSE})"


@query("dim_warehouse", sql.numbered(SITES, ["nume", "oras", "tara"], "depozit_id"))
def dim_warehouse(spark, sf_dir):
    sites = b.table(spark, sf_dir, "warehouse").drop("depozit_id").distinct()
    return assign_ids(sites, ["nume", "oras", "tara"], "depozit_id")


@query(
    "surrogate_keys",
    "SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, "
    "l_suppkey)) AS ids FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey "
    "FROM lineitem)",
)
def surrogate_keys(spark, sf_dir):
    """Ids over a large natural key: as many ids as rows."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = b.read(spark, sf_dir, "lineitem").select(*keys).distinct()
    ids = assign_ids(lines, keys, "line_id")
    return ids.agg(F.count("*").alias("rows"), F.countDistinct("line_id").alias("ids"))


OLD_NAMES = sql.numbered(
    "SELECT DISTINCT p_brand AS nume FROM part WHERE p_brand < 'Brand#2'", ["nume"], "producator_id"
)


@query(
    "merge_manufacturers",
    _merged(OLD_NAMES, "SELECT DISTINCT p_brand AS nume FROM part", ["nume"], "producator_id"),
)
def merge_manufacturers(spark, sf_dir):
    names = b.table(spark, sf_dir, "manufacturer").select("nume")
    old = assign_ids(names.where("nume < 'Brand#2'"), ["nume"], "producator_id")
    old = merge.table_rows(old, "manufacturer")
    merged = old.unionByName(merge.new_manufacturers(old, names))
    return merged.select("producator_id", "nume")


OLD_CATEGORIES = sql.numbered(
    "SELECT DISTINCT p_type AS nume FROM part WHERE p_type < 'M'", ["nume"], "categorie_id"
)


@query(
    "merge_categories",
    _merged(OLD_CATEGORIES, "SELECT DISTINCT p_type AS nume FROM part", ["nume"], "categorie_id"),
)
def merge_categories(spark, sf_dir):
    names = b.table(spark, sf_dir, "category").select("nume")
    old = assign_ids(names.where("nume < 'M'"), ["nume"], "categorie_id")
    old = merge.table_rows(old, "category")
    merged = old.unionByName(merge.new_categories(old, names))
    return merged.select("categorie_id", "nume")


OLD_CODES = sql.numbered(
    f"SELECT * FROM ({sql.codes()}) WHERE grup = 'SOCKET_CPU'", ["grup", "cod"], "standard_id"
)


@query("merge_standards", _merged(OLD_CODES, sql.codes(), ["grup", "cod"], "standard_id"))
def merge_standards(spark, sf_dir):
    codes = b.table(spark, sf_dir, "standard").select("grup", "cod")
    old = assign_ids(codes.where("grup = 'SOCKET_CPU'"), ["grup", "cod"], "standard_id")
    old = merge.table_rows(old, "standard")
    merged = old.unionByName(merge.new_standards(old, codes))
    return merged.select("standard_id", "grup", "cod")


# Warehouses of one region have no city on record.
BLANK_CITY = "CASE WHEN tara <> 'EUROPE' THEN oras END"
BLANK_SITES = f"SELECT nume, {BLANK_CITY} AS oras, tara FROM ({sql.WAREHOUSE})"
OLD_SITES = sql.numbered(
    f"SELECT * FROM ({BLANK_SITES}) WHERE tara IN ('ASIA', 'EUROPE')",
    ["nume", "oras", "tara"],
    "depozit_id",
)


@query(
    "merge_warehouses", _merged(OLD_SITES, BLANK_SITES, ["nume", "oras", "tara"], "depozit_id")
)
def merge_warehouses(spark, sf_dir):
    sites = b.table(spark, sf_dir, "warehouse").selectExpr("nume", f"{BLANK_CITY} AS oras", "tara")
    old = assign_ids(
        sites.where("tara IN ('ASIA', 'EUROPE')"), ["nume", "oras", "tara"], "depozit_id"
    )
    old = merge.table_rows(old, "warehouse")
    return old.unionByName(merge.new_warehouses(old, sites))


PRODUCT_SQL = (
    f"SELECT p_partkey AS n, {b.SKU} AS cod_sku, p_name AS denumire, categorie_id, producator_id "
    f"FROM part LEFT JOIN ({sql.CATEGORY}) c ON c.nume = p_type "
    f"LEFT JOIN ({sql.MANUFACTURER}) m ON m.nume = p_brand "
)
NEW_PRODUCTS = sql.numbered(
    f"{PRODUCT_SQL} WHERE p_type <> 'PROMO'",
    ["cod_sku"],
    "produs_id",
    "(SELECT max(p_partkey) FROM part WHERE p_type = 'PROMO')",
    digits=4,
)


@query(
    "merge_products",
    f"SELECT n AS produs_id, cod_sku, 'on record' AS denumire, categorie_id, producator_id, "
    f"12 AS garantie_luni, 'INACTIV' AS status FROM ({PRODUCT_SQL} WHERE p_type = 'PROMO') "
    "UNION ALL SELECT produs_id, cod_sku, denumire, categorie_id, producator_id, 24, 'ACTIV' "
    f"FROM ({NEW_PRODUCTS})",
)
def merge_products(spark, sf_dir):
    """Products on record keep their values; each new SKU arrives once."""
    products = b.table(spark, sf_dir, "product")
    categories, makers = b.table(spark, sf_dir, "category"), b.table(spark, sf_dir, "manufacturer")
    promo = categories.where("nume = 'PROMO'").select("categorie_id")
    old = merge.table_rows(
        products.join(promo, "categorie_id", "left_semi").selectExpr(
            "produs_id",
            "cod_sku",
            "'on record' AS denumire",
            "categorie_id",
            "producator_id",
            "12 AS garantie_luni",
            "'INACTIV' AS status",
        ),
        "product",
    )
    wide = b.wide_parts(spark, sf_dir)
    # Every row arrives twice; the later copy has another name.
    again = wide.selectExpr(
        *[c for c in wide.columns if c not in ("denumire", "source_row")],
        "denumire || ' again' AS denumire",
        "source_row + 1000000000000 AS source_row",
    )
    rows = merge.clean_wide(wide.unionByName(again))
    return old.unionByName(merge.new_products(old, rows, categories, makers, ["source_row"]))


@query(
    "merge_links",
    f"SELECT produs_id, standard_id FROM ({sql.links()}) JOIN ({sql.STANDARD}) USING (grup, cod)",
)
def merge_links(spark, sf_dir):
    standards = b.table(spark, sf_dir, "standard")
    every = b.table(spark, sf_dir, "product_standard")
    sockets = standards.where("grup = 'SOCKET_CPU'").select("standard_id")
    old = every.join(sockets, "standard_id", "left_semi").select("produs_id", "standard_id")
    links = b.standard_links(b.wide_parts(spark, sf_dir), b.STANDARDS_MAP)
    return old.unionByName(merge.new_links(old, links, b.table(spark, sf_dir, "product"), standards))


LINE_STOCK = (
    "SELECT 'P-' || CAST(l_partkey AS STRING) AS cod_sku, 'S-' || CAST(l_suppkey AS STRING) "
    "AS depozit, l_returnflag AS oras_depozit, l_linestatus AS tara_depozit, "
    "CAST(sum(l_quantity) AS BIGINT) AS cantitate, CAST(max(l_linenumber) AS BIGINT) AS prag_minim "
    "FROM lineitem GROUP BY ALL"
)


@query("stock_rollup", LINE_STOCK)
def stock_rollup(spark, sf_dir):
    return merge.stock_rollup(b.wide_lines(spark, sf_dir))


@query(
    "stock_rollup_fractions",
    "SELECT 'P-' || CAST(l_partkey AS STRING) AS cod_sku, CAST(trunc(sum(l_quantity / 4)) AS BIGINT) "
    "AS cantitate, CAST(trunc(max(l_quantity / 8)) AS BIGINT) AS prag_minim FROM lineitem GROUP BY 1",
)
def stock_rollup_fractions(spark, sf_dir):
    """Fractions of pieces: the total is cut, not each row."""
    lines = b.read(spark, sf_dir, "lineitem").selectExpr(
        "'P-' || CAST(l_partkey AS STRING) AS cod_sku",
        "'D' AS depozit",
        "'' AS oras_depozit",
        "'' AS tara_depozit",
        "CAST(l_quantity / 4 AS STRING) AS cantitate",
        "l_quantity / 8 AS prag_minim",
    )
    return merge.stock_rollup(lines).select("cod_sku", "cantitate", "prag_minim")


LARGE = "CAST(9007199254740993 AS DECIMAL(20,0)) + l_linenumber"


@query(
    "stock_rollup_large",
    f"SELECT 'P-' || CAST(l_partkey AS STRING) AS cod_sku, CAST(sum({LARGE}) AS BIGINT) AS cantitate, "
    f"CAST(max({LARGE}) AS BIGINT) AS prag_minim FROM lineitem GROUP BY 1",
)
def stock_rollup_large(spark, sf_dir):
    """Amounts of more digits than a double has."""
    lines = b.read(spark, sf_dir, "lineitem").selectExpr(
        "'P-' || CAST(l_partkey AS STRING) AS cod_sku",
        "'D' AS depozit",
        "'' AS oras_depozit",
        "'' AS tara_depozit",
        f"CAST({LARGE} AS DECIMAL(20,0)) AS cantitate",
        f"CAST({LARGE} AS STRING) AS prag_minim",
    )
    return merge.stock_rollup(lines).select("cod_sku", "cantitate", "prag_minim")


RETURNED = "l_returnflag = 'R'"
OLD_STOCK = sql.STOCK.format(where=f"WHERE {RETURNED}")
SUPPLIED = (
    "SELECT l_partkey AS produs_id, l_suppkey AS depozit_id, CAST(sum(l_quantity) AS BIGINT) "
    "AS cantitate, CAST(max(l_linenumber) AS BIGINT) AS prag_minim FROM lineitem GROUP BY ALL"
)


@query(
    "merge_stock",
    f"SELECT * FROM ({OLD_STOCK}) UNION ALL SELECT * FROM ({SUPPLIED}) i WHERE NOT EXISTS "
    f"(SELECT 1 FROM ({OLD_STOCK}) o WHERE o.produs_id = i.produs_id "
    "AND o.depozit_id = i.depozit_id)",
)
def merge_stock(spark, sf_dir):
    sites = b.table(spark, sf_dir, "warehouse")
    old = b.stock(spark, sf_dir, RETURNED)
    lines = b.read(spark, sf_dir, "lineitem")
    named = lines.join(sites, lines.l_suppkey == sites.depozit_id).selectExpr(
        "'P-' || CAST(l_partkey AS STRING) AS cod_sku",
        "nume AS depozit",
        "oras AS oras_depozit",
        "tara AS tara_depozit",
        "CAST(l_quantity AS BIGINT) AS cantitate",
        "l_linenumber AS prag_minim",
    )
    new = merge.new_stock(old, merge.stock_rollup(named), b.table(spark, sf_dir, "product"), sites)
    return old.unionByName(new)


CENTRAL = "SELECT 'Central' AS nume, 'Bucuresti' AS oras, 'RO' AS tara"
CENTRAL_ID = sql.numbered(
    CENTRAL, ["nume", "oras", "tara"], "depozit_id", "(SELECT max(s_suppkey) FROM supplier)"
)


def _with_central(spark, sf_dir):
    sites = b.table(spark, sf_dir, "warehouse")
    central = spark.createDataFrame([seed.WAREHOUSE], "nume string, oras string, tara string")
    return sites.unionByName(merge.new_warehouses(sites, central))


@query(
    "append_rows",
    f"SELECT depozit_id, nume, oras, tara FROM ({sql.WAREHOUSE}) UNION ALL "
    f"SELECT depozit_id, nume, oras, tara FROM ({CENTRAL_ID})",
)
def append_rows(spark, sf_dir):
    """A literal row added to a table."""
    return _with_central(spark, sf_dir)


@query(
    "opening_stock",
    "SELECT p_partkey AS produs_id, depozit_id, CAST(10 AS BIGINT) AS cantitate, "
    f"CAST(2 AS BIGINT) AS prag_minim FROM part, ({CENTRAL_ID})",
)
def opening_stock(spark, sf_dir):
    sites = _with_central(spark, sf_dir)
    return merge.opening_stock(
        b.table(spark, sf_dir, "product"),
        sites,
        *seed.WAREHOUSE,
        seed.OPENING_QUANTITY,
        seed.OPENING_THRESHOLD,
    )


@query(
    "register_product",
    "SELECT 'PRODUS' AS tabel, count(*) + 1 AS cnt FROM part UNION ALL "
    f"SELECT 'PRODUS_STANDARD', count(*) + 1 FROM ({sql.links()}) UNION ALL "
    f"SELECT 'STOC', count(*) + 1 FROM ({sql.STOCK.format(where='')})",
)
def register_product(spark, sf_dir):
    """One product, its link and its stock added twice by name: each is there once."""
    tables = b.tables(spark, sf_dir)
    tables["warehouse"] = _with_central(spark, sf_dir)
    product = spark.createDataFrame(
        [("NEW-1", "new part", "PROMO", "Brand#1", 36, "ACTIV")], seed.PRODUCT_DDL
    )
    links = tables["standard"].where("grup = 'MEM_TYPE'").groupBy("grup").agg(F.min("cod"))
    links = links.toDF("grup", "cod").withColumn("cod_sku", F.lit("NEW-1"))
    stock = spark.createDataFrame(
        [("NEW-1", *seed.WAREHOUSE, 5, 1)],
        "cod_sku string, depozit string, oras_depozit string, tara_depozit string, "
        "cantitate int, prag_minim int",
    )
    store = CatalogStore(spark, scratch_path(spark, "registered"))
    run = store.begin()
    for table in LOADED_TABLES:
        store.append(run, table, merge.table_rows(tables[table], table))
    store.commit(run)
    star_load.register(store, product, links, stock)
    star_load.register(store, product, links, stock)
    store.compact()
    reopened = CatalogStore(spark, store.root).tables()
    return q.table_counts({t: reopened[t] for t in ("product", "product_standard", "stock")})


def loaded_store(spark, sf_dir) -> CatalogStore:
    """The wide catalogue of the parts, loaded twice."""
    root = scratch_path(spark, "catalog")
    wide_catalog(spark, sf_dir).write.parquet(f"{root}/wide")
    wide = spark.read.parquet(f"{root}/wide")
    store = CatalogStore(spark, f"{root}/store")
    star_load.load(store, wide, order=ORDER)
    star_load.load(store, wide, order=ORDER)
    return store


LOADED = f"WITH w AS ({WIDE_SQL}), p AS (SELECT DISTINCT cod_sku FROM w) "
LOADED_LINKS = " UNION ".join(
    f"SELECT cod_sku, '{group}' AS grup, {column} AS cod FROM w WHERE {column} IS NOT NULL"
    for column, group in {
        **sql.GROUPS,
        "interface": "INTERFATA",
        "storage_form": "STORAGE_FORM",
    }.items()
)


@query(
    "load_catalog",
    f"{LOADED} SELECT 'PRODUCATOR' AS tabel, count(DISTINCT producator) AS cnt FROM w UNION ALL "
    "SELECT 'CATEGORIE', count(DISTINCT categorie) FROM w UNION ALL "
    f"SELECT 'STANDARD', count(DISTINCT (grup, cod)) FROM ({LOADED_LINKS}) UNION ALL "
    "SELECT 'DEPOZIT', 1 UNION ALL SELECT 'PRODUS', count(*) FROM p UNION ALL "
    f"SELECT 'PRODUS_STANDARD', count(*) FROM ({LOADED_LINKS}) UNION ALL "
    "SELECT 'STOC', count(*) FROM p",
)
def load_catalog(spark, sf_dir):
    return q.table_counts(loaded_store(spark, sf_dir).tables())


@query("load_catalog_from_csv", SQL["load_catalog"])
def load_catalog_from_csv(spark, sf_dir):
    """The wide catalogue, with names that span lines, written as CSV, read back and loaded."""
    root = scratch_path(spark, "from-csv")
    name = F.expr("denumire || chr(10) || '\"' || cod_sku")
    wide = wide_catalog(spark, sf_dir).withColumn("denumire", name)
    export_wide_csv(wide, f"{root}/products")
    store = CatalogStore(spark, f"{root}/store")
    star_load.load(store, read_wide_csv(spark, f"{root}/products"))
    return q.table_counts(store.tables())


@query(
    "load_catalog_products",
    f"{LOADED}, f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY cod_sku "
    "ORDER BY CASE WHEN categorie = 'Unknown' THEN 1 ELSE 0 END, denumire) = 1), "
    "q AS (SELECT cod_sku, CAST(10 * count(*) AS BIGINT) AS cantitate FROM w GROUP BY 1), "
    f"l AS (SELECT cod_sku, string_agg(grup || ':' || cod, ', ' ORDER BY grup, cod) AS standarde "
    f"FROM ({LOADED_LINKS}) GROUP BY 1) "
    "SELECT cod_sku, categorie, producator, q.cantitate, coalesce(standarde, ':') AS standarde "
    "FROM f JOIN q USING (cod_sku) LEFT JOIN l USING (cod_sku)",
)
def load_catalog_products(spark, sf_dir):
    """Loaded products by name: category, brand, stock and standards."""
    tables = loaded_store(spark, sf_dir).tables()
    listed = q.product_standards(tables).select("produs_id", "standarde")
    categories = tables["category"].selectExpr("categorie_id", "nume AS categorie")
    makers = tables["manufacturer"].selectExpr("producator_id", "nume AS producator")
    stocked = tables["stock"].select("produs_id", "cantitate")
    return (
        tables["product"]
        .join(stocked, "produs_id")
        .join(listed, "produs_id")
        .join(categories, "categorie_id", "left")
        .join(makers, "producator_id", "left")
        .select("cod_sku", "categorie", "producator", "cantitate", "standarde")
    )
