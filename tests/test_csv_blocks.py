"""CSV records over blocks against the csv module, and files that fail alone."""

from __future__ import annotations

import csv
import io
import random

import pytest

from partloom.plans.wide_catalog import export_wide_csv, read_wide_csv, write_wide
from partloom.schemas import WIDE_DDL
from partloom.sources import csv_blocks, csv_files

ORDER = ["source_block", "source_row"]


def read(spark, paths, columns, latin=False, block=None):
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = csv_blocks.read_records(spark, paths, columns, latin)
        return [tuple(r)[:columns] for r in rows.orderBy("source_file", *ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def expected(content, columns):
    rows = [r for r in csv.reader(io.StringIO(content, newline="")) if "".join(r).strip()]
    return [tuple(v or None for v in r[:columns]) for r in rows[1:]]


VALUES = ["a", "plain text", "two\nlines", 'say "hi"', "x,y", "\n\n", 'q"\n"q', "3.5\" disk", "é\nü", ""]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block", [70, 10_000_000])
def test_any_cut_gives_the_same_records(spark, tmp_path, seed, block):
    rng = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["h1", "h2", "h3"])
    for i in range(80):
        value = rng.choice(VALUES)
        if rng.random() < 0.05:
            value = "line\n" * 30 + "end"  # longer than a block
        writer.writerow([i, value, rng.choice(VALUES)])
        if rng.random() < 0.2:  # an inch mark outside quotes opens nothing
            out.write(f'{i},3.5" disk,2.5"\n')
        if rng.random() < 0.1:
            out.write("\n")
    content = out.getvalue()
    path = tmp_path / "a.csv"
    path.write_bytes(content.encode())
    assert read(spark, [str(path)], 3, block=block) == expected(content, 3)


def test_several_files_and_latin(spark, tmp_path):
    contents = ['n,t\n1,"é\nb"\n2,x\n', '\n\nn,t\n"3\n""q""",y\n', 'n,t\n"never closed\n4,z\n5,é\n']
    for i, content in enumerate(contents):
        (tmp_path / f"{i}.csv").write_bytes(content.encode("latin-1"))
    paths = [str(tmp_path / f"{i}.csv") for i in range(3)]
    got = read(spark, paths, 2, latin=True, block=9)
    assert got[:3] == [("1", "é\nb"), ("2", "x"), ('3\n"q"', "y")]
    assert len(got) == 4 and got[3][0].startswith("never closed\n4,z\n5,é")


def test_carriage_returns(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'n,t\r\n1,"a\r\nb"\r\n2,x\r\n')
    assert read(spark, [str(path)], 2) == [("1", "a\r\nb"), ("2", "x")]


def test_files_with_spans_are_split(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("n,t\n" + "".join(f'{i},"x\ny"\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8000)
    try:
        rows = csv_files.read_products(spark, [str(path)])
        assert rows is not None
        lines = csv_blocks._lines(spark, [str(path)], False)
        assert lines.select("block").distinct().count() > 4
        found = csv_blocks.read_records(spark, [str(path)], 2)
        assert found.where("c1 = 'x\ny'").count() == found.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_catalogue_with_line_breaks(spark, tmp_path):
    row = ("s", 'two\n"lines"', "CPU", "A", 24, "ACTIV", "C", None, "RO", 10, 2) + (None,) * 5
    wide = spark.createDataFrame([row, ("t", *row[1:])], WIDE_DDL).repartition(2, "cod_sku")
    export_wide_csv(wide, str(tmp_path / "csv"))
    rows = read_wide_csv(spark, str(tmp_path / "csv"))
    assert sorted((r.cod_sku, r.denumire, r.cantitate) for r in rows.collect()) == [
        ("s", row[1], "10"),
        ("t", row[1], "10"),
    ]
    with pytest.raises(FileNotFoundError):
        read_wide_csv(spark, str(tmp_path / "none"))


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    row = ("s", "n", "CPU", "A", 24, "ACTIV", "C", None, "RO", 10, 2) + (None,) * 5
    wide = spark.createDataFrame([(*row, i % 4) for i in range(10)], f"{WIDE_DDL}, source_rank int")
    counts = write_wide(wide, str(tmp_path / "wide"))
    assert counts == {"rows": 10, "CPU": 3, "Motherboard": 3, "RAM": 2, "mixed": 2}
    assert write_wide(wide.limit(0), str(tmp_path / "none"))["rows"] == 0


def test_one_unreadable_file_costs_no_other(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"Name,sku\npart {i},p-{i}\n")
    (tmp_path / "blank.csv").write_text("\n")
    # A checksum that does not fit: every attempt to read the file fails.
    (tmp_path / ".3.csv.crc").write_bytes(b"crc\x00\x00\x00\x02\x00" + b"\x01\x02\x03\x04")
    outcomes = []
    with pytest.warns(UserWarning) as caught:
        rows = csv_files.read_folder(spark, str(tmp_path), outcomes=outcomes)
    assert sorted(r.cod_sku for r in rows.collect()) == ["p-0", "p-1", "p-2", "p-4"]
    messages = {str(w.message) for w in caught}
    assert {"1 files have no header", "1 files cannot be read"} <= messages
    kinds = {o.path.rsplit("/", 1)[1]: o.outcome for o in outcomes}
    assert kinds == {
        **{f"{i}.csv": "read" for i in (0, 1, 2, 4)},
        "3.csv": "unreadable",
        "blank.csv": "no header",
    }
    assert next(o for o in outcomes if o.outcome == "unreadable").reason
    csv_files.write_outcomes(spark, outcomes, str(tmp_path / "outcomes"))
    assert spark.read.parquet(str(tmp_path / "outcomes")).count() == 6
