"""Constraint checks."""

from __future__ import annotations

from partloom.operators import checks
from partloom.operators.joins import lacking

from workload import binding as b
from workload import sql
from workload.registry import query


@query(
    "duplicate_names",
    "SELECT p_name AS denumire, count(*) AS cnt FROM part GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_names(spark, sf_dir):
    return checks.duplicates(b.table(spark, sf_dir, "product"), ["denumire"])


@query(
    "duplicate_order_lines",
    "SELECT l_orderkey AS cv_id, l_linenumber AS linie_nr, count(*) AS cnt FROM lineitem "
    "GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_order_lines(spark, sf_dir):
    return checks.duplicates(b.order_line(spark, sf_dir), ["cv_id", "linie_nr"])


FINISHED = "o_orderstatus = 'F'"
# Orders that are not finished are on record under another number.
FINISHED_KEY = f"CASE WHEN {FINISHED} THEN o_orderkey ELSE -1 - o_orderkey END"


@query(
    "orphan_order_lines",
    "SELECT l_orderkey AS cv_id, count(*) AS cnt FROM lineitem WHERE l_orderkey NOT IN "
    f"(SELECT o_orderkey FROM orders WHERE {FINISHED}) GROUP BY 1",
)
def orphan_order_lines(spark, sf_dir):
    orders = b.sales_order(spark, sf_dir, FINISHED_KEY)
    return checks.orphans(b.order_line(spark, sf_dir), "cv_id", orders, "cv_id")


@query(
    "orphan_returns",
    f"SELECT cv_id, count(*) AS cnt FROM (SELECT {b.OPTIONAL_ORDER} AS cv_id FROM lineitem "
    "WHERE l_returnflag = 'R') WHERE cv_id IS NOT NULL AND cv_id NOT IN "
    f"(SELECT o_orderkey FROM orders WHERE {FINISHED}) GROUP BY 1",
)
def orphan_returns(spark, sf_dir):
    """An optional foreign key: no order is no violation."""
    orders = b.sales_order(spark, sf_dir, FINISHED_KEY)
    return checks.orphans(b.rma(spark, sf_dir), "cv_id", orders, "cv_id")


@query(
    "customer_kind_violations",
    f"SELECT {b.TIP} AS tip, count(*) AS cnt FROM customer "
    f"WHERE {b.TIP} NOT IN ('B2B', 'B2C') GROUP BY 1",
)
def customer_kind_violations(spark, sf_dir):
    return checks.outside_domain(b.customer(spark, sf_dir), "tip", ("B2B", "B2C"))


@query(
    "order_status_violations",
    "SELECT o_orderstatus AS status, count(*) AS cnt FROM orders "
    "WHERE o_orderstatus NOT IN ('ACTIV', 'INACTIV') GROUP BY 1",
)
def order_status_violations(spark, sf_dir):
    return checks.outside_domain(b.sales_order(spark, sf_dir), "status", ("ACTIV", "INACTIV"))


@query(
    "products_without_standard_list",
    f"WITH links AS ({sql.links(b.SPARSE_CODES)}) SELECT {b.SKU} AS cod_sku, p_name AS denumire "
    "FROM part WHERE p_partkey NOT IN (SELECT produs_id FROM links)",
)
def products_without_standard_list(spark, sf_dir):
    links = b.table(spark, sf_dir, "sparse_product_standard")
    bare = lacking(b.table(spark, sf_dir, "product"), links, ["produs_id"])
    return bare.select("cod_sku", "denumire")


# The bound tables in SQL, columns the constraints read.
SQL_TABLES = {
    "manufacturer": sql.MANUFACTURER,
    "category": sql.CATEGORY,
    "standard": sql.STANDARD,
    "product": (
        f"SELECT p_partkey AS produs_id, {b.SKU} AS cod_sku, categorie_id, producator_id, "
        f"'ACTIV' AS status FROM part JOIN ({sql.CATEGORY}) c ON c.nume = p_type "
        f"JOIN ({sql.MANUFACTURER}) m ON m.nume = p_brand"
    ),
    "product_standard": (
        f"SELECT produs_id, standard_id FROM ({sql.links()}) "
        f"JOIN ({sql.STANDARD}) USING (grup, cod)"
    ),
    "warehouse": sql.WAREHOUSE,
    "stock": sql.STOCK.format(where=""),
    "customer": f"SELECT c_custkey AS client_id, {b.TIP} AS tip FROM customer",
    "sales_order": "SELECT o_orderkey AS cv_id, o_custkey AS client_id FROM orders",
    "order_line": (
        "SELECT l_orderkey AS cv_id, l_linenumber AS linie_nr, l_partkey AS produs_id FROM lineitem"
    ),
    "shipment": "SELECT l_orderkey AS cv_id, l_suppkey AS depozit_id FROM lineitem",
    "rma": (
        f"SELECT o_custkey AS client_id, l_partkey AS produs_id, {b.OPTIONAL_ORDER} AS cv_id "
        "FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'"
    ),
}


def _report_sql() -> str:
    def summary(name: str, violations: str) -> str:
        return (
            f"SELECT '{name}' AS constraint_name, count(*) AS keys, "
            f"CAST(coalesce(sum(cnt), 0) AS BIGINT) AS rows FROM ({violations})"
        )

    parts = []
    for table, keys in checks.UNIQUE_KEYS:
        columns = ", ".join(keys)
        parts.append(
            summary(
                f"unique {table}({columns})",
                f"SELECT {columns}, count(*) AS cnt FROM {table}_t GROUP BY ALL "
                "HAVING count(*) > 1",
            )
        )
    for child, foreign_key, parent, key in checks.FOREIGN_KEYS:
        parts.append(
            summary(
                f"{child}.{foreign_key} in {parent}",
                f"SELECT {foreign_key}, count(*) AS cnt FROM {child}_t c WHERE {foreign_key} "
                f"IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent}_t p "
                f"WHERE p.{key} = c.{foreign_key}) GROUP BY 1",
            )
        )
    for table, column, allowed in checks.DOMAINS:
        parts.append(
            summary(
                f"{table}.{column} in domain",
                f"SELECT {column}, count(*) AS cnt FROM {table}_t "
                f"WHERE {column} NOT IN {allowed} GROUP BY 1",
            )
        )
    tables = ", ".join(f"{name}_t AS ({rows})" for name, rows in SQL_TABLES.items())
    return f"WITH {tables} {' UNION ALL '.join(parts)}"


@query("constraint_report", _report_sql())
def constraint_report(spark, sf_dir):
    return checks.constraint_report(b.all_tables(spark, sf_dir))
