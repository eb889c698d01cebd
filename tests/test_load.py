"""Loads that add only what is absent."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from partloom import session
from partloom.operators import checks, merge
from partloom.plans import catalog_queries as q
from partloom.plans import star_load
from partloom.schemas import WIDE_DDL
from partloom.sources.store import CatalogStore

ORDER_DDL = "source_rank int, source_file string, source_block long, source_row long"
SITE = ("Central", None, "RO")


def wide(spark, rows):
    full = [
        (sku, name, category, brand, 24, "ACTIV", *SITE, 10, 2, socket, None, None, None, None)
        + (0, "", 0, i)
        for i, (sku, name, category, brand, socket) in enumerate(rows)
    ]
    return spark.createDataFrame(full, f"{WIDE_DDL}, {ORDER_DDL}")


ROWS = [
    ("s1", "first", "CPU", "Acme", "AM5"),
    ("s1", "second", "GPU", "Bolt", "AM4"),
    ("s2", "other", None, None, "NONE"),
    (None, "no sku", "CPU", "Acme", None),
    (None, "no sku either", "CPU", "Acme", None),
]


def test_load_twice_is_load_once(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "store"))
    assert store.version == 0 and store.read("product").count() == 0
    first = star_load.load(store, wide(spark, ROWS))
    assert first.version == 1
    assert first.added == {
        "manufacturer": 2,
        "category": 2,
        "standard": 3,
        "warehouse": 1,
        "product": 4,
        "product_standard": 2,
        "stock": 2,
    }
    again = star_load.load(store, wide(spark, ROWS))
    assert again.version == 2 and set(again.added.values()) == {0}

    tables = store.tables()
    products = {r["cod_sku"]: r for r in tables["product"].collect() if r["cod_sku"]}
    assert products["s1"]["denumire"] == "first"
    assert products["s2"]["categorie_id"] is None and products["s2"]["producator_id"] is None
    stock = {r["produs_id"]: r["cantitate"] for r in tables["stock"].collect()}
    assert stock[products["s1"]["produs_id"]] == 20
    listed = {r["cod_sku"]: r["standarde"] for r in q.product_standards(tables).collect()}
    assert listed["s1"] == "SOCKET_CPU:AM4, SOCKET_CPU:AM5" and listed["s2"] == ":"
    assert tables["warehouse"].first()["oras"] is None
    # Products without SKU are no violation of its uniqueness.
    assert checks.constraint_report(tables).where("keys > 0").count() == 0


def test_later_load_adds_and_changes_nothing(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "store"))
    star_load.load(store, wide(spark, ROWS[:1]))
    before = store.tables()["product"].collect()
    report = star_load.load(
        store, wide(spark, [("s1", "renamed", "RAM", "Core", "AM5"), ("s9", "n", "RAM", "C", "X")])
    )
    assert report.added["product"] == 1 and report.added["stock"] == 1
    after = store.tables()["product"].where("cod_sku = 's1'").collect()
    assert before == after
    ids = [r["produs_id"] for r in store.tables()["product"].collect()]
    assert len(set(ids)) == 2
    assert store.read("product", version=1).count() == 1


def test_uncommitted_rows_are_not_seen(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "store"))
    star_load.load(store, wide(spark, ROWS[:1]))
    run = store.begin()
    store.append(run, "category", merge.table_rows(spark.range(5), "category"))
    assert CatalogStore(spark, store.root).read("category").count() == 1
    other = CatalogStore(spark, store.root)
    star_load.load(other, wide(spark, ROWS))
    with pytest.raises(RuntimeError, match="another load"):
        store.commit(run)


def test_of_two_commits_at_once_one_fails(spark, tmp_path):
    one = CatalogStore(spark, str(tmp_path / "store"))
    star_load.load(one, wide(spark, ROWS[:1]))
    other = CatalogStore(spark, one.root)
    runs = one.begin(), other.begin()
    other.refresh = lambda: other.version  # it looked before the first commit
    one.commit(runs[0])
    with pytest.raises(RuntimeError, match="another load"):
        other.commit(runs[1])


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "store"))
    star_load.load(store, wide(spark, ROWS[:1]))
    star_load.load(store, wide(spark, ROWS))
    before = sorted(store.read("product").collect())
    assert store.compact() == 3
    again = CatalogStore(spark, store.root)
    assert sorted(again.read("product").collect()) == before
    assert again.read("product", version=1).count() == 1
    assert len(again.read("product").inputFiles()) < 1 + len(
        again.read("product", version=2).inputFiles()
    )


def test_absent_warranty_and_status(spark):
    bare = wide(spark, ROWS).drop("garantie_luni", "status")
    rows = merge.clean_wide(bare).select("garantie_luni", "status").distinct().collect()
    assert [tuple(r) for r in rows] == [(24, "ACTIV")]


def test_fractions_are_cut_after_the_sum(spark):
    rows = [("s", "d", "", "", 1.5, 2.7), ("s", "d", "", "", 1.5, 2.2)]
    ddl = "cod_sku string, depozit string, oras_depozit string, tara_depozit string, "
    frame = spark.createDataFrame(rows, ddl + "cantitate double, prag_minim double")
    assert [tuple(r)[-2:] for r in merge.stock_rollup(frame).collect()] == [(3, 2)]


def test_load_without_stock_columns(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "store"))
    rows = wide(spark, ROWS).drop("cantitate")
    report = star_load.load(store, rows)
    assert report.added["product"] == 4 and report.added["stock"] == 0


def test_stock_of_one_sku_under_two_names(spark):
    rolled = merge.stock_rollup(merge.clean_wide(wide(spark, ROWS[:2])))
    assert [(r["cantitate"], r["prag_minim"]) for r in rolled.collect()] == [(20, 2)]


def test_opening_stock_needs_the_warehouse(spark):
    product = spark.range(3).withColumnRenamed("id", "produs_id")
    site = spark.createDataFrame(
        [(7, "Central", "Bucuresti", "RO")],
        "depozit_id long, nume string, oras string, tara string",
    )
    there = merge.opening_stock(product, site, "Central", "Bucuresti", "RO", 10, 2)
    assert {tuple(r) for r in there.collect()} == {(i, 7, 10, 2) for i in range(3)}
    assert merge.opening_stock(product, site, "Nord", "Bucuresti", "RO", 10, 2).count() == 0


def test_checks(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (1,)], "id int")
    assert [tuple(r) for r in checks.orphans(child, "fk", parent, "id").collect()] == [(2, 2)]
    assert [tuple(r) for r in checks.duplicates(child, ["fk"]).collect()] == [(2, 2)]
    kinds = spark.createDataFrame([("B2B",), ("x",), (None,)], "tip string")
    wrong = checks.outside_domain(kinds, "tip", ("B2B", "B2C"))
    assert [tuple(r) for r in wrong.collect()] == [("x", 1)]


def test_each_table_is_read_once_for_its_constraints(spark, tmp_path):
    rows = [(1, 1, 5), (1, 1, 6), (2, 1, 7), (None, 2, 5)]
    spark.createDataFrame(rows, "cv_id long, linie_nr int, produs_id long").write.parquet(
        str(tmp_path / "lines")
    )
    tables = {
        "order_line": spark.read.parquet(str(tmp_path / "lines")),
        "sales_order": spark.createDataFrame([(1, 9)], "cv_id long, client_id long"),
        "product": spark.createDataFrame(
            [(5, "a", 1, 1, "ACTIV"), (6, None, 1, 1, "x"), (7, None, 1, 1, None)],
            "produs_id long, cod_sku string, categorie_id long, producator_id long, status string",
        ),
    }
    report = checks.constraint_report(tables)
    found = {r["constraint_name"]: (r["keys"], r["rows"]) for r in report.collect()}
    assert found == {
        "unique product(cod_sku)": (0, 0),
        "unique order_line(cv_id, linie_nr)": (1, 2),
        "order_line.cv_id in sales_order": (1, 1),
        "order_line.produs_id in product": (0, 0),
        "product.status in domain": (1, 1),
    }
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [cv_id") == 1


def test_listing_of_orphan_links(spark):
    tables = {
        "product": spark.createDataFrame(
            [(1, "s", "n")], "produs_id long, cod_sku string, denumire string"
        ),
        "product_standard": spark.createDataFrame(
            [(1, 5), (1, 6), (1, 5)], "produs_id long, standard_id long"
        ),
        "standard": spark.createDataFrame(
            [(5, "G", "c")], "standard_id long, grup string, cod string"
        ),
    }
    assert q.product_standards(tables).first()["standarde"] == "G:c, :"
    assert q.product_standards(tables).select(F.col("cod_sku")).first()[0] == "s"


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    assert session.scratch_path(spark, "x").startswith(shared.rstrip("/"))
    rows = session.stored(spark.range(3), "three")
    assert rows.count() == 3 and rows.dtypes == [("id", "bigint")]


def test_sums_have_every_digit(spark):
    odd = 9007199254740993
    ddl = "cod_sku string, depozit string, oras_depozit string, tara_depozit string, "
    key = ("s", "d", "", "")
    for kind, value in (("decimal(20,0)", Decimal(odd)), ("string", str(odd)), ("bigint", odd)):
        frame = spark.createDataFrame([(*key, value, value)] * 10, f"{ddl}cantitate {kind}, prag_minim {kind}")
        assert [tuple(r)[-2:] for r in merge.stock_rollup(frame).collect()] == [(10 * odd, odd)]
    texts = [(*key, "1e2", "x"), (*key, "0.1", None), (*key, "", "3.9")]
    frame = spark.createDataFrame(texts, f"{ddl}cantitate string, prag_minim string")
    assert [tuple(r)[-2:] for r in merge.stock_rollup(frame).collect()] == [(100, 3)]
    tenths = spark.createDataFrame([(*key, 0.1, float("nan"))] * 10, f"{ddl}cantitate double, prag_minim double")
    assert [tuple(r)[-2:] for r in merge.stock_rollup(tenths).collect()] == [(1, None)]


def test_text_keys_with_nulls(spark):
    rows = [(1, "A", None, "RO"), (2, "A", "RO", None), (3, "A", None, "RO"), (4, None, None, None)]
    rows += [(5, None, None, None)]
    ddl = "depozit_id long, nume string, oras string, tara string"
    tables = {"warehouse": spark.createDataFrame(rows, ddl)}
    found = {r["constraint_name"]: (r["keys"], r["rows"]) for r in checks.constraint_report(tables).collect()}
    assert found == {"unique warehouse(nume, oras, tara)": (1, 2)}


def test_keys_of_unlike_types_meet_by_their_text(spark):
    tables = {
        "sales_order": spark.createDataFrame([("1", 9), ("x", 9)], "cv_id string, client_id long"),
        "order_line": spark.createDataFrame([(1, 1), (2, 1)], "cv_id long, linie_nr int").selectExpr(
            "*", "CAST(NULL AS long) AS produs_id"
        ),
    }
    found = {r["constraint_name"]: (r["keys"], r["rows"]) for r in checks.constraint_report(tables).collect()}
    assert found["order_line.cv_id in sales_order"] == (1, 1)


def test_constraints_join_no_keys(spark):
    rows = spark.createDataFrame([(1, 5)], "cv_id long, client_id long")
    report = checks.constraint_report({"sales_order": rows, "customer": rows.withColumnRenamed("cv_id", "x").withColumn("tip", F.lit("B2B"))})
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the list of constraints and its totals
