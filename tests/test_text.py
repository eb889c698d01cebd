"""Cleaning rules on single values."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partloom.functions import text


def apply(spark, rule, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("v"))).collect()]


SOCKETS = {
    "socket am4": "AM4",
    "AM3+": "AM3",
    "LGA1151-2": "LGA1151",
    "lga1200 (v1)": "LGA1200",
    "LGA2011-3 Narrow": "LGA2011",
    "Intel LGA 775 processor": "LGA775",
    "2 x LGA3647": "LGA3647",
    "AM3/AM2+": "AM3",
    "XAM5Y": "AM5",
    "FM2+": "FM2",
    "LGA 12": "LGA 12",
    "LGA123456": "LGA123456",
    "sTRX4": "STRX4",
    "CPU Socket (old)": None,
    "  ": None,
    None: None,
}


def test_normalize_socket(spark):
    assert apply(spark, text.normalize_socket, SOCKETS) == list(SOCKETS.values())


def test_clean_text(spark):
    values = [" a ", "nan", " None ", "", "\t\n", "NaN", None, "\xa0x　"]
    expected = ["a", None, None, None, None, "NaN", None, "x"]
    assert apply(spark, text.clean_text, values) == expected


def test_null_to_blank(spark):
    assert apply(spark, text.null_to_blank, [" a ", None, " "]) == ["a", "", ""]


def test_codes(spark):
    values = ["AM5", "NONE", "None", "nan", " ", None]
    assert apply(spark, text.is_standard_code, values) == [True, True, False, False, False, False]
    assert apply(spark, text.is_link_code, values) == [True, False, False, False, False, False]


def test_warranty(spark):
    values = ["36.9", "abc", None, " 12 ", "1e1", "36d", "", "99999999999", "1e30"]
    assert apply(spark, text.warranty_months, values) == [36, 24, 24, 12, 10] + [24] * 4


def test_status(spark):
    values = ["INACTIV", "inactiv", "", None, " ACTIV "]
    expected = ["INACTIV", "ACTIV", "ACTIV", "ACTIV", "ACTIV"]
    assert apply(spark, text.status_or_default, values) == expected


@pytest.mark.parametrize(
    ("brand", "name", "sku"),
    [
        ("Kingston", "Fury 16GB DDR5 (2x8) kit", "KINGST-FURY-16GB-DDR5-(2X8)"),
        ("", "101", "-101"),
        (None, "a  b", "NAN-A-B"),
        ("x", None, "X-NAN"),
        ("x", " a\t\nb ", "X--A-B-"),
    ],
)
def test_derive_sku(spark, brand, name, sku):
    row = spark.createDataFrame([(brand, name)], "b string, n string")
    assert row.select(text.derive_sku(F.col("b"), F.col("n"))).first()[0] == sku[: 7 + 20]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=20, max_size=40))
def test_strip_is_whole(spark, values):
    values = [v for v in values if "\x00" not in v and v.isprintable() or v.isspace()]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("AMLG 2345()socketcpu-+", max_size=14), min_size=30, max_size=60))
def test_socket_names_are_stable(spark, values):
    """A normalised name stays as it is when normalised again."""
    once = apply(spark, text.normalize_socket, values)
    assert apply(spark, text.normalize_socket, [v for v in once if v]) == [v for v in once if v]


def test_no_run_of_noise_is_too_long(spark):
    """Every pattern of the library over long runs that would nest or backtrack."""
    from partloom.functions import decode
    from partloom.sources import csv_blocks, parts_files

    units = ["- ", "(", "()", "(a) ", "SOCKET", "CPU(", ")(", "a.", ".", "1", "1.", "1e", "9,", '"', '""', '",', " "]
    values = [unit * (10_000 // len(unit)) + end for unit in units for end in ("", "x", "\n", '"')]
    rules = [
        text.normalize_socket,
        text.to_number,
        text.warranty_months,
        text.hyphenate,
        text.clean_text,
        decode.numbers,
        decode.token,
        decode.text_list,
        decode.capacity_gb,
        decode.efficiency,
        lambda c: decode.price(c, True),
        csv_blocks.ends_inside,
    ]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    found = rows.select(*[rule(F.col("v")).alias(f"r{i}") for i, rule in enumerate(rules)])
    assert len(found.collect()) == len(values)
    paths = rows.select(F.concat(F.lit("/"), "v").alias("path"))
    assert paths.select(*parts_files.file_columns()).count() == len(values)


def test_a_megabyte_of_noise_is_no_socket(spark):
    noise = ["- " * 500_000, "(" * 1_000_000, "()" * 500_000, "SOCKET" * 170_000, ")" * 1_000_000]
    assert apply(spark, text.normalize_socket, noise) == [None] * 5
    named = [f"{'- ' * 500_000}socket (x) am4", f"LGA 1700{'(y)' * 300_000}"]
    assert apply(spark, text.normalize_socket, named) == ["AM4", "LGA1700"]
    assert apply(spark, text.to_number, ["1" * 1_000_000 + "x"]) == [None]


BRACKETS = {
    "(a(b)c": "C",
    "a(b)c(d": "A C D",
    "a)b(c": "A B C",
    "x (one\ntwo) y": "X ONE TWO Y",
    "soc(x)ket": "SOC KET",
    "cpusocketx": "X",
    "()": None,
}


def test_brackets_of_a_socket(spark):
    assert apply(spark, text.normalize_socket, BRACKETS) == list(BRACKETS.values())
