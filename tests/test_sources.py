"""Files of many shapes."""

from __future__ import annotations

import json
import warnings

import pytest
from pyspark.sql import functions as F

from partloom.plans.wide_catalog import build_wide, export_wide_csv, write_wide
from partloom.sources import csv_files, discovery, parts_files


def write(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_find_file(spark, tmp_path):
    write(tmp_path / "deep" / "er" / "cpu.csv", "a\n")
    write(tmp_path / "b" / "cpu.csv", "a\n")
    write(tmp_path / "my_cpu_list.csv", "a\n")
    root = str(tmp_path)
    assert discovery.find_file(spark, root, ["cpu.csv", "*cpu*.csv"]).endswith("/b/cpu.csv")
    assert discovery.find_file(spark, root, ["x.csv", "my*.csv"]).endswith("my_cpu_list.csv")
    assert discovery.find_file(spark, root, ["x.csv"]) is None
    assert discovery.find_file(spark, root + "/none", ["*"]) is None


def test_profile(spark, tmp_path):
    paths = [
        write(tmp_path / "a.csv", "name,x\ncafé,1\n"),
        write(tmp_path / "b.csv", "name,x\ncafé,1\n", "latin-1"),
        write(tmp_path / "c.csv", "﻿name,x\n\"a\nb\",1\n"),
        write(tmp_path / "d.csv", "\n\nprénom,x\n1,2\n", "latin-1"),
        write(tmp_path / "e.csv", ""),
    ]
    profile = {
        r["path"].rsplit("/", 1)[1]: (r["utf8"], r["multi_line"], r["header"])
        for r in csv_files.profile_csv(spark, paths).collect()
    }
    assert profile == {
        "a.csv": (True, False, "name,x"),
        "b.csv": (False, False, "name,x"),
        "c.csv": (True, True, "name,x"),
        "d.csv": (False, False, "prénom,x"),
    }


@pytest.mark.parametrize(
    ("line", "spans"),
    [
        ('3.5" drive,1', False),
        ('a,3.5" drive', False),
        ('"a ""b"", c",1', False),
        ('"a""', True),
        ('x,"a', True),
        ('"whole","open ""quote"" here', True),
        ('"whole",inch 5",,"', True),
        (',"",""', False),
        ('"a" tail,b', False),
    ],
)
def test_values_that_span_lines(spark, tmp_path, line, spans):
    path = write(tmp_path / "a.csv", f"x,y\n{line}\n")
    assert csv_files.profile_csv(spark, [path]).first()["multi_line"] is spans


def test_long_lines_are_profiled(spark, tmp_path):
    fields = ",".join(['"a ""quoted"" b"', "plain", '5"'] * 5000)
    path = write(tmp_path / "a.csv", f"x\n{fields}\n{'""' * 50_000}\n")
    assert csv_files.profile_csv(spark, [path]).first()["multi_line"] is False


def test_header_names():
    assert csv_files.header_names('a,"b,c",,a,') == ("a", "b,c", "Unnamed: 2", "a.1", "Unnamed: 4")


def test_folder_of_unlike_files(spark, tmp_path):
    write(tmp_path / "a.csv", "Name,Brand,Type\ncafé,Acme,CPU\n\"say \"\"hi\"\", you\",Acme,CPU\n")
    write(tmp_path / "x" / "b.csv", "model,maker,CPU Socket\ncafé,Bolt,am4\n", "latin-1")
    write(tmp_path / "x" / "c.csv", 'Model,pn\n"two\nlines",p-1\n')
    write(tmp_path / "x" / "d.csv", 'Model,pn\n3.5" disk,p-2\n2.5" disk,p-3\n')
    write(tmp_path / "x" / "blank.csv", "\n\n")
    with pytest.warns(UserWarning, match="1 files have no header"):
        products = csv_files.read_folder(spark, str(tmp_path))
    rows = {r["denumire"]: r for r in products.collect()}
    assert len(rows) == 5 and products.count() == 6
    assert rows['3.5" disk']["cod_sku"] == "p-2"
    assert rows["two\nlines"]["cod_sku"] == "p-1"
    assert rows['say "hi", you']["categorie"] == "CPU"
    socketed = [r for r in products.collect() if r["socket"]]
    assert [(r["denumire"], r["producator"]) for r in socketed] == [("café", "Bolt")]


def test_rows_keep_file_order(spark, tmp_path):
    lines = "\n".join(f"sku,{i}" for i in range(20_000))
    path = write(tmp_path / "big.csv", f"id,name\n{lines}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        rows = csv_files.read_products(spark, [path])
        assert rows.rdd.getNumPartitions() > 4
        ordered = rows.orderBy(*csv_files.ORDER_COLUMNS).select("denumire").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r[0]) for r in ordered] == list(range(20_000))


@pytest.mark.parametrize("delimiter", [",", ";", "|", "\t"])
def test_standards_map(spark, tmp_path, delimiter):
    rows = [
        ["RAW_COLUMN", "GRUP"],
        ["socket", "OLD"],
        ["", "X"],
        ["memory", "MEM_TYPE"],
        [" socket ", " SOCKET_CPU "],
        ["unused", "U"],
    ]
    content = "﻿" + "\n\n".join(delimiter.join(r) for r in rows)
    path = write(tmp_path / "map.csv", content)
    found = csv_files.read_standards_map(spark, path, ["memory", "socket"])
    assert found == {"memory": "MEM_TYPE", "socket": "SOCKET_CPU"}


def test_no_standards_map(spark, tmp_path):
    with pytest.warns(UserWarning, match="no standards map"):
        assert csv_files.read_standards_map(spark, str(tmp_path / "none.csv"), ["a"]) == {}


def test_wide_catalog_of_folders(spark, tmp_path):
    write(tmp_path / "parts" / "d" / "cpu.csv", "name,socket\nRyzen,Socket AM5\nRyzen,AM4\n")
    write(tmp_path / "mixed" / "m.csv", "Unnamed: 0,MRP\n101,5\n181,6\n101,7\n")
    with pytest.warns(UserWarning) as caught:
        wide = build_wide(spark, str(tmp_path / "parts"), str(tmp_path / "mixed"))
    messages = [str(w.message) for w in caught if w.category is UserWarning]
    assert sorted(m.split(" below")[0] for m in messages) == [
        "no file for Motherboard",
        "no file for RAM",
    ]
    write_wide(wide, str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide"))
    rows = {r["cod_sku"]: r for r in stored.collect()}
    assert set(rows) == {"-RYZEN", "-101", "-181"}
    assert rows["-RYZEN"]["socket"] == "AM5" and rows["-RYZEN"]["categorie"] == "CPU"
    assert rows["-101"]["categorie"] == "Unknown" and rows["-101"]["producator"] is None
    export_wide_csv(stored, str(tmp_path / "csv"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert "-101,101,Unknown,,24,ACTIV,Central,Bucuresti,RO,10,2,,,,," in lines


def test_all_sources_absent(spark, tmp_path):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(FileNotFoundError):
            build_wide(spark, str(tmp_path / "a"), str(tmp_path / "b"))


FANS = [
    {"name": "A, \"x\"", "price": 9.99, "size": 120, "color": None, "rpm": [500, 1500]},
    {"name": "B", "price": None, "size": 87.5, "color": "Black / White", "rpm": 900, "pwm": True},
    {"name": "C", "price": 24100, "size": None, "color": "", "rpm": [1, None], "pwm": False},
]


def test_json_arrays_lines_and_csv(spark, tmp_path):
    write(tmp_path / "json" / "case-fan.json", json.dumps(FANS))
    write(tmp_path / "json" / "os.incomplete.json", '[{"name": "w", "mode": [32, 64]}]')
    write(tmp_path / "lines" / "case-fan.jsonl", "\n".join(json.dumps(f) for f in FANS))
    folder = str(tmp_path / "json")
    counts = {tuple(r) for r in parts_files.count_parts(spark, folder).collect()}
    assert counts == {("case-fan", "complete", 3), ("os", "incomplete", 1)}

    frames = parts_files.read_category_folder(spark, folder, ["case-fan", "os"])
    fans = frames["case-fan"].drop("load_status")
    rows = {r["name"]: r for r in fans.collect()}
    assert rows['A, "x"']["rpm"] == [500, 1500] and rows["B"]["rpm"] == [900]
    assert rows["B"]["pwm"] is True and rows["C"]["pwm"] is False
    os = frames["os"].first()
    assert os["mode"] == [32, 64] and os["load_status"] == "incomplete"

    lines = parts_files.read_category_folder(
        spark, str(tmp_path / "lines"), ["case-fan"], json_lines=True
    )["case-fan"].drop("load_status")
    assert sorted(map(str, lines.collect())) == sorted(map(str, fans.collect()))

    out = str(tmp_path / "out")
    parts_files.write_json_lines(fans, "case-fan", out)
    written = {json.loads(r[0])["name"]: json.loads(r[0]) for r in spark.read.text(out).collect()}
    assert written["B"]["rpm"] == 900 and written["C"]["rpm"] == [1, None]
    assert written['A, "x"']["color"] is None
    text = spark.read.text(out).where(F.col("value").contains('"C"')).first()[0]
    assert text.startswith('{"name":"C","price":24100,"size":null,')

    parts_files.write_parts_csv(fans, "case-fan", str(tmp_path / "csv"))
    header = spark.read.text(str(tmp_path / "csv")).where("value like 'name,%'").first()[0]
    assert header == "name,price,size,color,rpm,airflow,noise_level,pwm"
    back = {
        r["name"]: r
        for r in parts_files.read_parts_csv(spark, str(tmp_path / "csv"), "case-fan").collect()
    }
    assert back['A, "x"']["rpm"] == [500, 1500]
    assert back["B"]["size"] == [87.5] and back["B"]["pwm"] is True


def test_category_layout_reads_only_its_folders(spark, tmp_path):
    df = spark.createDataFrame([("os", 1), ("ups", 2), ("ups", 3)], "category string, i int")
    parts_files.write_by_category(df, str(tmp_path / "p"))
    ups = parts_files.read_by_category(spark, str(tmp_path / "p"), ["ups"])
    assert ups.count() == 2
    plan = ups._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "category" in plan.split("PartitionFilters: [")[1]
