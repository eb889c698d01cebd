"""The catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import text
from partloom.plans import catalog_queries as q
from partloom.plans import code_index
from partloom.session import scratch_path

from workload import binding as b
from workload import sql
from workload.registry import query

LINKS = f"WITH links AS ({sql.links()}) "
SOURCE_SKU = "P-7"


@query(
    "products_per_category",
    "SELECT p_type AS categorie, count(*) AS produse FROM part GROUP BY 1",
)
def products_per_category(spark, sf_dir):
    return q.products_per_category(b.tables(spark, sf_dir, "product", "category"))


@query(
    "standards_per_group",
    f"SELECT grup, count(*) AS nr_standard FROM ({sql.codes()}) GROUP BY 1",
)
def standards_per_group(spark, sf_dir):
    return q.standards_per_group(b.tables(spark, sf_dir, "standard"))


@query(
    "links_per_group",
    f"SELECT grup, count(*) AS nr_legaturi FROM ({sql.links()}) GROUP BY 1",
)
def links_per_group(spark, sf_dir):
    return q.links_per_group(b.tables(spark, sf_dir, "product_standard", "standard"))


def _compatible_sql(group: str, categories: str) -> str:
    return (
        f"{LINKS} SELECT {b.SKU} AS cod_sku, p_name AS denumire "
        "FROM part JOIN links ON produs_id = p_partkey "
        f"WHERE p_type IN ({categories}) AND grup = '{group}' AND upper(cod) IN ("
        "SELECT upper(cod) FROM links JOIN part ON produs_id = p_partkey "
        f"WHERE {b.SKU} = '{SOURCE_SKU}' AND grup = '{group}')"
    )


def _compatible(spark, sf_dir, group, categories):
    return q.compatible(b.tables(spark, sf_dir), SOURCE_SKU, group, categories)


@query("compatible_by_socket", _compatible_sql("SOCKET_CPU", "'LARGE', 'PROMO', 'SMALL'"))
def compatible_by_socket(spark, sf_dir):
    return _compatible(spark, sf_dir, q.SOCKET_GROUP, ("LARGE", "PROMO", "SMALL"))


@query("compatible_by_memory_type", _compatible_sql("MEM_TYPE", "'MEDIUM'"))
def compatible_by_memory_type(spark, sf_dir):
    return _compatible(spark, sf_dir, q.MEMORY_GROUP, ("MEDIUM",))


@query("compatible_by_form_factor", _compatible_sql("FORM_FACTOR_MB", "'ECONOMY'"))
def compatible_by_form_factor(spark, sf_dir):
    return _compatible(spark, sf_dir, q.BOARD_FORM_GROUP, ("ECONOMY",))


# Boards by the names that the sorted query looks for.
BOARD_NAMES = {"LARGE": "Motherboard", "PROMO": "mobo", "SMALL": "Mainboard"}


@query("compatible_boards", _compatible_sql("SOCKET_CPU", "'LARGE', 'PROMO', 'SMALL'"))
def compatible_boards(spark, sf_dir):
    """The query for boards itself, sorted by name, over categories that are named as boards."""
    tables = b.tables(spark, sf_dir)
    name = F.col("nume")
    for plain, board in BOARD_NAMES.items():
        name = F.when(F.col("nume") == plain, board).otherwise(name)
    tables["category"] = tables["category"].withColumn("nume", name)
    return q.compatible_boards(tables, SOURCE_SKU)


def _code_index(spark, sf_dir):
    return code_index.write_code_index(b.tables(spark, sf_dir), scratch_path(spark, "codes"))


@query("compatible_by_index", _compatible_sql("SOCKET_CPU", "'LARGE', 'PROMO', 'SMALL'"))
def compatible_by_index(spark, sf_dir):
    """Products that share a socket, from the stored index of codes."""
    index, tables = _code_index(spark, sf_dir), b.tables(spark, sf_dir)
    return code_index.compatible(
        index, tables, SOURCE_SKU, q.SOCKET_GROUP, ("LARGE", "PROMO", "SMALL")
    )


@query(
    "codes_per_category_by_index",
    f"{LINKS} SELECT p_type AS categorie, cod AS socket, count(*) AS nr FROM links "
    "JOIN part ON produs_id = p_partkey WHERE grup = 'SOCKET_CPU' GROUP BY 1, 2",
)
def codes_per_category_by_index(spark, sf_dir):
    return code_index.codes_per_category(_code_index(spark, sf_dir), q.SOCKET_GROUP)


@query(
    "stock_by_category",
    "SELECT p_type AS categorie, CAST(sum(l_quantity) AS BIGINT) AS total_cantitate "
    "FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def stock_by_category(spark, sf_dir):
    return q.largest_stock(b.tables(spark, sf_dir))


CRITICAL_SQL = (
    f"SELECT p_name AS denumire, nume AS depozit, cantitate, prag_minim "
    f"FROM ({sql.STOCK.format(where='')}) s JOIN part ON p_partkey = s.produs_id "
    f"JOIN ({sql.WAREHOUSE}) d ON d.depozit_id = s.depozit_id WHERE cantitate < prag_minim"
)


@query("critical_stock", CRITICAL_SQL)
def critical_stock(spark, sf_dir):
    return q.critical_stock(b.tables(spark, sf_dir))


@query(
    "critical_stock_view",
    f"SELECT depozit, count(*) AS produse, CAST(sum(prag_minim - cantitate) AS BIGINT) AS lipsa "
    f"FROM ({CRITICAL_SQL}) GROUP BY 1",
)
def critical_stock_view(spark, sf_dir):
    """SQL over the named view, as a user writes it."""
    q.create_views(spark, b.tables(spark, sf_dir))
    return spark.sql(
        "SELECT depozit, count(*) AS produse, sum(prag_minim - cantitate) AS lipsa "
        "FROM vw_stoc_critic GROUP BY depozit"
    )


FULL_RETURNS = "l_quantity > 49 AND l_returnflag = 'R'"


@query(
    "products_without_stock",
    f"SELECT {b.SKU} AS cod_sku, p_name AS denumire FROM part WHERE NOT EXISTS "
    f"(SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND {FULL_RETURNS})",
)
def products_without_stock(spark, sf_dir):
    """All other lines are stock of products that the catalogue does not have."""
    product = f"CASE WHEN {FULL_RETURNS} THEN l_partkey ELSE -1 - l_partkey END"
    stock = b.stock(spark, sf_dir, product=product)
    return q.products_without_stock({**b.tables(spark, sf_dir, "product"), "stock": stock})


@query(
    "duplicate_skus",
    "SELECT upper(substr(p_brand, 1, 6)) || '-' || upper(substr(replace(p_name, ' ', '-'), 1, 20)) "
    "AS cod_sku, count(*) AS cnt FROM part GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_skus(spark, sf_dir):
    sku = text.derive_sku(F.col("p_brand"), F.col("p_name"))
    return q.duplicate_skus({"product": b.read(spark, sf_dir, "part").select(sku.alias("cod_sku"))})


@query(
    "products_without_standard",
    f"WITH links AS ({sql.links(b.SPARSE_CODES)}) SELECT count(*) AS produse_fara_standard "
    "FROM part WHERE NOT EXISTS (SELECT 1 FROM links WHERE produs_id = p_partkey)",
)
def products_without_standard(spark, sf_dir):
    return q.products_without_standard(b.sparse_tables(spark, sf_dir))


@query(
    "codes_per_category",
    f"{LINKS} SELECT p_type AS categorie, cod AS socket, count(*) AS nr FROM links "
    "JOIN part ON produs_id = p_partkey WHERE grup = 'SOCKET_CPU' GROUP BY 1, 2",
)
def codes_per_category(spark, sf_dir):
    return q.codes_per_category(b.tables(spark, sf_dir))


@query(
    "product_standards",
    f"WITH links AS ({sql.links(b.SPARSE_CODES)}) SELECT p_partkey AS produs_id, "
    f"{b.SKU} AS cod_sku, p_name AS denumire, "
    "coalesce(string_agg(grup || ':' || cod, ', ' ORDER BY grup, cod), ':') AS standarde "
    "FROM part LEFT JOIN links ON produs_id = p_partkey GROUP BY 1, 2, 3",
)
def product_standards(spark, sf_dir):
    return q.product_standards(b.sparse_tables(spark, sf_dir))


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS tabel, count(*) AS cnt FROM ({rows})"
        for name, rows in {
            "PRODUCATOR": "SELECT DISTINCT p_brand FROM part",
            "CATEGORIE": "SELECT DISTINCT p_type FROM part",
            "STANDARD": sql.codes(),
            "PRODUS": "SELECT * FROM part",
            "PRODUS_STANDARD": sql.links(),
            "DEPOZIT": sql.WAREHOUSE,
            "STOC": sql.STOCK.format(where=""),
            "CLIENT": "SELECT * FROM customer",
            "COMANDA_VANZARE": "SELECT * FROM orders",
            "CV_LINIE": "SELECT * FROM lineitem",
            "EXPEDIERE": "SELECT * FROM lineitem",
            "RMA": "SELECT * FROM lineitem WHERE l_returnflag = 'R'",
        }.items()
    ),
)
def table_counts(spark, sf_dir):
    return q.table_counts(b.all_tables(spark, sf_dir))


@query("table_dump", f"SELECT grup, cod, standard_id FROM ({sql.STANDARD})")
def table_dump(spark, sf_dir):
    """SELECT * over a table by its SQL name."""
    q.create_views(spark, b.tables(spark, sf_dir))
    return spark.sql("SELECT * FROM STANDARD").drop("descriere")


@query(
    "products_by_sku",
    f"SELECT {b.SKU} AS cod_sku, p_name AS denumire FROM part WHERE {b.SKU} = '{SOURCE_SKU}'",
)
def products_by_sku(spark, sf_dir):
    """A query with a bind value."""
    b.table(spark, sf_dir, "product").createOrReplaceTempView("PRODUS")
    return spark.sql(
        "SELECT cod_sku, denumire FROM PRODUS WHERE cod_sku = :sku", args={"sku": SOURCE_SKU}
    )
