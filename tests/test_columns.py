"""Column resolution and the wide catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import columns, reshape
from partloom.schemas import RESOLVED_COLUMNS, WIDE_COLUMNS


def test_first_match_in_frame_order():
    found = columns.resolve_header(["x", "Title", "name", "SKU", "id", "Maker", "Category"])
    assert [found[c] for c in ("denumire", "cod_sku", "producator", "categorie")] == [1, 3, 5, 6]


def test_memory_type_goes_by_priority_and_case():
    assert columns.resolve_header(["memory", "ram_type"])["memory_type"] == 1
    assert columns.resolve_header(["Memory_Type", "memory"])["memory_type"] == 1
    assert columns.resolve_header(["RAM_TYPE"])["memory_type"] is None


def test_fragments():
    found = columns.resolve_header(["CPU Socket", "Form-Factor", "Business", "M.2 slots"])
    assert [found[c] for c in ("socket", "form_factor", "interface", "storage_form")] == [
        0,
        1,
        2,
        3,
    ]


def test_names_that_spark_cannot_tell_apart(spark):
    """Dots, repeats and names that differ in case only."""
    df = spark.createDataFrame([("a", "b", "c", "d")], ["c0", "c1", "c2", "c3"])
    header = ["M.2", "Name", "NAME", "type.x"]
    row = columns.resolve_columns(df, header=header).first()
    assert row["denumire"] == "b"
    assert row["storage_form"] == "a"
    assert row["categorie"] == "Unknown"
    assert tuple(row.asDict()) == RESOLVED_COLUMNS


def test_defaults(spark):
    df = spark.createDataFrame([("  nan ", "socket am4 ")], "name string, socket string")
    wide = columns.wide_order(
        columns.add_wide_defaults(columns.clean_resolved(columns.resolve_columns(df, "CPU")))
    )
    assert tuple(wide.columns) == WIDE_COLUMNS
    row = wide.first()
    assert row["denumire"] is None
    assert row["categorie"] == "CPU"
    assert row["socket"] == "AM4"
    assert (row["cantitate"], row["prag_minim"], row["garantie_luni"]) == (10, 2, 24)
    assert (row["depozit"], row["oras_depozit"], row["tara_depozit"]) == (
        "Central",
        "Bucuresti",
        "RO",
    )


def test_keep_first_takes_nulls_as_equal(spark):
    rows = [("a", None, 3), ("a", None, 1), ("a", "x", 2), (None, None, 5), (None, None, 4)]
    df = spark.createDataFrame(rows, "sku string, name string, at int")
    kept = reshape.keep_first(df, ["sku", "name"], ["at"])
    assert kept.columns == ["sku", "name", "at"]
    assert {tuple(r) for r in kept.collect()} == {("a", None, 1), ("a", "x", 2), (None, None, 4)}


def test_keep_first_with_one_hot_key(spark):
    """All rows but a few share a key; the plan holds an aggregate, no window."""
    df = spark.range(100_000).select(
        F.when(F.col("id") < 99_000, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        (100_000 - F.col("id")).alias("at"),
        "id",
    )
    kept = reshape.keep_first(df, ["k"], ["at"])
    assert kept.count() == 1001
    assert kept.where("k = 'hot'").first()["id"] == 98_999
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_unpivot_keeps_only_mapped_columns(spark):
    df = spark.createDataFrame(
        [("s1", " AM5 ", "NONE"), ("s1", "AM5", None), ("s2", "nan", "DDR5")],
        "cod_sku string, socket string, ram_type string",
    )
    mapping = {"socket": "SOCKET_CPU", "ram_type": "MEM_TYPE", "bus": "INTERFATA"}
    assert {tuple(r) for r in reshape.standard_codes(df, mapping).collect()} == {
        ("SOCKET_CPU", "AM5"),
        ("MEM_TYPE", "NONE"),
        ("MEM_TYPE", "DDR5"),
    }
    assert sorted(tuple(r) for r in reshape.standard_links(df, mapping).collect()) == [
        ("s1", "SOCKET_CPU", "AM5"),
        ("s2", "MEM_TYPE", "DDR5"),
    ]
    assert reshape.standard_codes(df, {"bus": "INTERFATA"}).count() == 0


def test_unpivot_and_pivot_undo_each_other(spark):
    rows = [("s1", "AM5", "DDR5"), ("s2", "AM4", None), ("s3", None, "DDR4")]
    df = spark.createDataFrame(rows, "cod_sku string, socket string, memory_type string")
    links = reshape.standard_links(df, {"socket": "S", "memory_type": "M"})
    back = links.groupBy("cod_sku").pivot("grup", ["S", "M"]).agg(F.first("cod"))
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(rows, key=str)
