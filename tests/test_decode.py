"""Spec decoders on single values and on records."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from partloom.functions import decode
from partloom.operators import specs
from partloom.plans import spec_dataset
from partloom.schemas import RAW_SPEC_DDL, SPEC_CATEGORIES
from tests.test_text import apply


def test_numbers(spark):
    cases = {
        "DDR5-6000": [5, 6000],
        "n/a": None,
        "5.": [5],
        "1..2": [1, 0.2],
        "$1,234.56": [1, 234.56],
        ".": None,
        "a . 3": [None, 3],
        "-7 RPM": [7],
        "": None,
        None: None,
    }
    assert apply(spark, decode.numbers, cases) == list(cases.values())


def test_tokens(spark):
    cases = {"None": None, "Yes": "true", "NO": "false", "Black": "Black", None: None}
    assert apply(spark, decode.token, cases) == list(cases.values())


def test_list(spark):
    assert apply(spark, decode.text_list, ["Windows, OS X", "Linux"]) == [
        ["Windows", "OS X"],
        ["Linux"],
    ]


def test_capacity(spark):
    cases = {"500 GB": 500, "2 TB": 2000, "7": None, "500 MB": 500000, "x GB": None, " GB": None}
    assert apply(spark, decode.capacity_gb, cases) == list(cases.values())
    scaled = apply(spark, lambda c: decode.capacity_gb(c, True), ["500 MB", "2 TB", "8 GB"])
    assert scaled == [0.5, 2000, 8]


def test_drives(spark):
    kinds = ["SSD", "7200 RPM"]
    assert apply(spark, decode.drive_type_text, kinds) == ["SSD", None]
    assert apply(spark, decode.drive_type_numbers, kinds) == [None, [7200]]
    forms = ['3.5"', "M.2-2280"]
    assert apply(spark, decode.drive_form_text, forms) == [None, "M.2-2280"]
    assert apply(spark, decode.drive_form_numbers, forms) == [[3.5], None]


def test_efficiency(spark):
    assert apply(spark, decode.efficiency, ["80+ Gold", "80+", None]) == ["gold", "plus", None]


def test_price(spark):
    assert apply(spark, decode.price, ["$9.99", " ", None, "$1,234.5"]) == [
        [9.99],
        None,
        None,
        [1, 234.5],
    ]
    assert apply(spark, lambda c: decode.price(c, True), ["$1,234.5"]) == [[1234.5]]


def test_plain_number(spark):
    cases = {
        87.0: "87",
        9.99: "9.99",
        24100.0: "24100",
        12345678.9: "12345678.9",
        0.001: "0.001",
        0.12345678901234566: "0.12345678901234566",
        1e-6: "0.000001",
        -2.5e-7: "-2.5e-7",
        1e-13: "1e-13",
        1e30: "1e+30",
        -1.25e21: "-1.25e+21",
        123456789012345680000.0: "123456789012345680000",
        0.0: "0",
        None: None,
        float("inf"): None,
    }
    written = apply(spark, decode.plain_number, list(cases), "double")
    assert written == list(cases.values())
    assert [t if t is None else float(t) for t in written[:-1]] == list(cases)[:-1]


def test_flag_takes_yes_and_no_only(spark):
    values = ["Yes", "NO", "1", "t", "Y", "true", "None", None]
    assert apply(spark, decode.flag, values) == [True, False] + [None] * 6


RAW = [
    ("memory", 1, "Fury\n16GB", "$50", 0, "Speed", "DDR5-6000"),
    ("memory", 1, "Fury\n16GB", "$50", 1, " Modules ", "2 x 8GB"),
    ("memory", 1, "Fury\n16GB", "$50", 2, "Color", "None"),
    ("memory", 1, "Fury\n16GB", "$50", 3, "Color", "Black"),
    ("memory", 2, "bare", " ", 0, None, None),
    ("headphones", 3, "h", "$7", 0, "Wireless", "Yes"),
    ("headphones", 3, "h", "$7", 1, "Type", " "),
]


def test_records(spark):
    raw = spark.createDataFrame(RAW, RAW_SPEC_DDL)
    memory = {r["item_id"]: r for r in specs.decode_wide(raw, "memory").collect()}
    assert memory[1]["name"] == "Fury 16GB"
    assert memory[1]["price"] == [50]
    assert memory[1]["speed"] == [5, 6000]
    assert memory[1]["modules"] == [2, 8]
    assert memory[1]["color"] == "Black"
    assert memory[2]["price"] is None and memory[2]["speed"] is None
    head = specs.decode_wide(raw, "headphones").first()
    assert head["wireless"] is True and head["type"] is None


def test_unknown_label_stops(spark):
    raw = spark.createDataFrame(
        [*RAW, ("memory", 4, "m", "$1", 0, "Weight", "1 g")], RAW_SPEC_DDL
    )
    with pytest.raises(PySparkException, match="no mapping for label Weight"):
        specs.decode_long(raw).collect()
    assert specs.decode_long(raw, fail_on_unknown=False).count() == 6
    assert [r["label"] for r in specs.unknown_labels(raw).collect()] == ["Weight"]
    bare = spark.createDataFrame([("memory", 5, "m", "$1", 0, None, "1 g")], RAW_SPEC_DDL)
    assert [r["item_id"] for r in specs.unknown_labels(bare).collect()] == [5]
    with pytest.raises(PySparkException, match="no mapping for label null"):
        specs.decode_long(bare).collect()
    status = specs.decode_with_status(raw).select("category", "load_status").distinct()
    assert {tuple(r) for r in status.collect()} == {
        ("memory", "incomplete"),
        ("headphones", "complete"),
    }


def test_every_category_decodes(spark):
    raw = spark.createDataFrame(RAW, RAW_SPEC_DDL)
    assert len(SPEC_CATEGORIES) == 25
    for category in SPEC_CATEGORIES:
        columns = specs.decode_wide(raw, category).columns
        assert columns == ["item_id", *specs.record_columns(category)]
    with pytest.raises(ValueError, match="unknown part category"):
        specs.decode_wide(raw, "toaster")


def test_long_and_wide_agree(spark):
    raw = spark.createDataFrame(RAW, RAW_SPEC_DDL).where(F.col("position") != 2)
    long = {(r["item_id"], r["field"]): r for r in specs.decode_long(raw).collect()}
    wide = specs.decode_wide(raw, "memory").where("item_id = 1").first()
    assert long[1, "speed"]["numbers"] == wide["speed"]
    assert long[1, "color"]["text"] == wide["color"]


ODD_RAW = [
    *RAW,
    ("memory", 4, "m", "$1", 0, "Weight", "1 g"),
    ("os", 5, "o", "$1", 0, "Mode", "32-bit"),
    ("os", 5, "o", "$1", 1, "Mode", "64-bit"),
    ("ups", 6, "u", "$1", 0, None, "1 g"),
    ("toaster", 7, "t", "$1", 0, "Slots", "2"),
]


def test_all_categories_from_one_pass(spark, tmp_path):
    spark.createDataFrame(ODD_RAW, RAW_SPEC_DDL).write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    items = specs.gathered(raw)
    status = specs.category_status(items)
    assert status._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {tuple(r) for r in status.collect()} == {
        ("memory", "incomplete", 2),
        ("headphones", "complete", 1),
        ("os", "complete", 1),
        ("ups", "incomplete", 0),
    }
    for category in ("memory", "headphones", "os"):
        kept = raw.where("coalesce(label, '') <> 'Weight'")
        wanted = specs.decode_wide(kept, category)
        found = specs.records_of(items, category)
        assert found.columns == wanted.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_categories_are_written_by_one_job_and_moved(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame(ODD_RAW, RAW_SPEC_DDL)
    passes = []
    once = spec_dataset.gathered
    monkeypatch.setattr(spec_dataset, "gathered", lambda rows: passes.append(1) or once(rows))
    root = str(tmp_path / "out")
    status = spec_dataset.write_categories(raw, root)
    assert status == {"memory": "incomplete", "headphones": "complete", "os": "complete"}
    assert len(passes) == 1
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["headphones.jsonl", "memory.incomplete.jsonl", "os.jsonl"]
    lines = [r.value for r in spark.read.text(f"{root}/os.jsonl").collect()]
    assert lines == ['{"name":"o","price":1,"mode":64,"max_memory":null}']
    # A later whole load takes the place of the broken one.
    whole = raw.where("coalesce(label, '') <> 'Weight' AND category = 'memory'")
    assert spec_dataset.write_categories(whole, root) == {"memory": "complete"}
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["headphones.jsonl", "memory.jsonl", "os.jsonl"]
    assert spec_dataset.write_categories(raw.limit(0), root) == {}


def test_unknown_labels_stop_records_by_default(spark):
    raw = spark.createDataFrame(ODD_RAW, RAW_SPEC_DDL)
    with pytest.raises(PySparkException, match="no mapping for label Weight"):
        specs.decode_wide(raw, "memory").collect()
    assert specs.decode_wide(raw, "memory", fail_on_unknown=False).count() == 2


def test_a_label_named_very_often_is_one_text(spark):
    rows = [("os", 1, "n", "$1", i, "Mode", f"{i}") for i in range(500)]
    items = specs.gathered(spark.createDataFrame(rows, RAW_SPEC_DDL)).collect()
    assert [r["_texts"] for r in items] == [{"mode": "499"}]
