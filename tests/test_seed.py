"""Queries on the sample catalogue."""

from __future__ import annotations

import pytest

from partloom.operators import merge
from partloom.plans import catalog_queries as q
from partloom.plans.seed import PRODUCT_DDL, seed_tables


@pytest.fixture(scope="module")
def seed(spark):
    return {name: frame.cache() for name, frame in seed_tables(spark).items()}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sizes(seed):
    sizes = {name: frame.count() for name, frame in seed.items()}
    assert sizes == {
        "manufacturer": 7,
        "category": 6,
        "standard": 9,
        "product": 10,
        "product_standard": 16,
        "warehouse": 1,
        "stock": 10,
    }


def test_overview(seed):
    assert rows(q.products_per_category(seed)) == [
        ("CPU", 2),
        ("Motherboard", 2),
        ("RAM", 2),
        ("Storage", 2),
        ("Case", 1),
        ("GPU", 1),
    ]
    groups = ["FORM_FACTOR_MB", "INTERFATA", "MEM_TYPE", "SOCKET_CPU", "STORAGE_FORM"]
    assert rows(q.standards_per_group(seed)) == list(zip(groups, [2, 1, 2, 2, 2]))
    assert rows(q.links_per_group(seed)) == list(zip(groups, [3, 1, 6, 4, 2]))


def test_compatibility(seed):
    assert rows(q.compatible_boards(seed, "AMD-R5-7600")) == [
        ("ASUS-B650-PLUS", "ASUS TUF GAMING B650-PLUS")
    ]
    assert [r[0] for r in rows(q.compatible_memory(seed, "ASUS-B650-PLUS"))] == ["KINGSTON-D5-16"]
    assert [r[0] for r in rows(q.compatible_cases(seed, "ASUS-B650-PLUS"))] == ["ASUS-CASE-ATX"]
    assert rows(q.compatible_cases(seed, "no such sku")) == []


def test_stock(seed):
    assert rows(q.largest_stock(seed)) == [
        ("CPU", 20),
        ("Motherboard", 20),
        ("RAM", 20),
        ("Storage", 20),
        ("Case", 10),
        ("GPU", 10),
    ]
    assert rows(q.critical_stock(seed)) == []
    assert rows(q.products_without_stock(seed)) == []


def test_quality(seed):
    assert rows(q.duplicate_skus(seed)) == []
    assert rows(q.products_without_standard(seed)) == [(0,)]
    assert rows(q.codes_per_category(seed)) == [
        ("CPU", "AM5", 1),
        ("CPU", "LGA1700", 1),
        ("Motherboard", "AM5", 1),
        ("Motherboard", "LGA1700", 1),
    ]


def test_listing(spark, seed):
    listed = {r["cod_sku"]: r["standarde"] for r in q.product_standards(seed).collect()}
    assert listed["ASUS-B650-PLUS"] == "FORM_FACTOR_MB:ATX, MEM_TYPE:DDR5, SOCKET_CPU:AM5"
    bare = dict(seed, product_standard=seed["product_standard"].limit(0))
    assert {r["standarde"] for r in q.product_standards(bare).collect()} == {":"}


def test_views_answer_sql(spark, seed):
    q.create_views(spark, seed)
    assert spark.sql("SELECT COUNT(*) FROM PRODUS").first()[0] == 10
    top = spark.sql("SELECT * FROM vw_stoc_pe_categorie ORDER BY total_cantitate DESC").first()
    assert top["total_cantitate"] == 20
    assert spark.sql("SELECT * FROM vw_stoc_critic").count() == 0
    assert spark.sql(
        "SELECT standarde FROM vw_produs_standarde WHERE cod_sku = :sku",
        args={"sku": "GIGABYTE-RTX4060"},
    ).first()[0] == "INTERFATA:PCIe x16"


def test_register_product(spark, seed):
    product = spark.createDataFrame(
        [("KINGSTON-D5-32", "Kingston Fury 32GB DDR5 (2x16)", "RAM", "Kingston", 36, "ACTIV")],
        PRODUCT_DDL,
    )
    links = spark.createDataFrame(
        [("KINGSTON-D5-32", "MEM_TYPE", "DDR5")], "cod_sku string, grup string, cod string"
    )
    stock = spark.createDataFrame(
        [("KINGSTON-D5-32", "Central", "Bucuresti", "RO", 5, 1)],
        "cod_sku string, depozit string, oras_depozit string, tara_depozit string, "
        "cantitate int, prag_minim int",
    )
    once = merge.register_product(seed, product, links, stock)
    counts = dict(rows(q.products_per_category(once)))
    assert counts["RAM"] == 3
    assert {r[0] for r in rows(q.compatible_memory(once, "ASUS-B650-PLUS"))} == {
        "KINGSTON-D5-16",
        "KINGSTON-D5-32",
    }
    assert dict(rows(q.largest_stock(once)))["RAM"] == 25
    twice = merge.register_product(once, product, links, stock)
    for table in ("product", "product_standard", "stock"):
        assert twice[table].count() == once[table].count() == seed[table].count() + 1
