"""The stored index of codes: what it reads, and hot codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.plans import catalog_queries as q
from partloom.plans import code_index


def catalogue(spark, hot=4000):
    """Most products have one socket; a few have others, in unlike spellings."""
    products = [(i, f"P-{i}", f"name {i}", 1 + i % 2, 1, 24, "ACTIV") for i in range(hot + 20)]
    links = [(i, 1 if i < hot else 2 + i % 3) for i, *_ in products]
    links += [(0, 4), (0, 5)]
    return {
        "category": spark.createDataFrame(
            [(1, "CPU", None), (2, "Motherboard", None)],
            "categorie_id long, nume string, descriere string",
        ),
        "standard": spark.createDataFrame(
            [(1, "SOCKET_CPU", "AM4", None), (2, "SOCKET_CPU", "LGA1700", None)]
            + [(3, "SOCKET_CPU", "am5", None), (4, "socket_cpu", "AM5", None)]
            + [(5, "MEM_TYPE", "DDR5", None)],
            "standard_id long, grup string, cod string, descriere string",
        ),
        "product": spark.createDataFrame(
            products,
            "produs_id long, cod_sku string, denumire string, categorie_id long, "
            "producator_id long, garantie_luni int, status string",
        ),
        "product_standard": spark.createDataFrame(links, "produs_id long, standard_id long"),
    }


def test_same_rows_as_the_tables(spark, tmp_path):
    tables = catalogue(spark, 200)
    index = code_index.write_code_index(tables, str(tmp_path / "index"), 6)
    for sku in ("P-0", "P-205", "P-206", "none"):
        wanted = q.compatible(tables, sku, q.SOCKET_GROUP, q.BOARD_CATEGORIES)
        found = code_index.compatible(index, tables, sku, q.SOCKET_GROUP, q.BOARD_CATEGORIES)
        assert sorted(found.collect()) == sorted(wanted.collect())
    wanted = [tuple(r) for r in q.codes_per_category(tables).collect()]
    assert [tuple(r) for r in code_index.codes_per_category(index, "SOCKET_CPU").collect()] == wanted


def test_more_codes_than_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(code_index, "LISTED_CODES", 1)
    tables = catalogue(spark, 50)
    index = code_index.write_code_index(tables, str(tmp_path / "index"))
    found = code_index.compatible(index, tables, "P-0", q.SOCKET_GROUP, q.BOARD_CATEGORIES)
    wanted = q.compatible(tables, "P-0", q.SOCKET_GROUP, q.BOARD_CATEGORIES)
    assert sorted(found.collect()) == sorted(wanted.collect())


def test_the_code_is_compared_in_the_scan(spark, tmp_path):
    tables = catalogue(spark, 50)
    index = code_index.write_code_index(tables, str(tmp_path / "index"), 4)
    found = code_index.compatible(index, tables, "P-0", q.SOCKET_GROUP, q.BOARD_CATEGORIES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "In(code, [" in pushed and "(category_key" in pushed
    assert "PartitionFilters: [isnotnull(group_key" in plan
    assert "upper(" not in plan and "Join" not in plan


def test_a_hot_code_lies_in_many_files(spark, tmp_path):
    index = code_index.write_code_index(catalogue(spark), str(tmp_path / "index"), 8)
    rows = index.where("group_key = 'SOCKET_CPU' AND code = 'AM4'")
    per_file = rows.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 4
    assert max(r["count"] for r in per_file) <= 1000
