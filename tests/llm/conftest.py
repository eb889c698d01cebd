from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"
CLASHING = (
    "node string, name string, m int, score string, spans int, body string, id string, h string, "
    "votes string, kept string, text_hash string, items string, label string, removed string, "
    "value string, kind string, windows string, n_hit string, posterior string, licenses string, "
    "_words string, _lines string, _hashes string, _text string, _removed string, _id string, "
    "_hash string, _gone string, _said string, _kinds string, _of string, _blocks string"
)


@pytest.fixture(scope="session")
def small():
    return os.environ.get("TEST_SF_DIR", SMALL)


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with every awkward row, and extra columns named like internal ones."""
    line = "One line that is long enough to be seen again, word by word, in another document."
    repeat = "\n".join([line, "A second line that follows it, also more than once here.", "end"])
    long_text = " ".join(f"word{i % 5000}" for i in range(60_000))
    texts = [
        (1, repeat),
        (2, None),
        (3, ""),
        (4, " \t\n\r\x0b\x0c "),
        (5, "Word"),
        (6, "two words"),
        (7, repeat),
        (7, repeat),
        (8, "first version of a document with some words in it"),
        (8, "second version of a document, quite another one"),
        (None, repeat),
        (None, None),
        (9, long_text),
        (10, long_text + " and a tail"),
        (11, "x" * 70_000),
        (12, "Ünïcödé wörds — „quoted“ 漢字 кириллица 🙂   ends\n\n\n"),
        (13, "a b " * 400),
        (14, "idiot moron trash " * 30),
        # Runs that a pattern could read again and again, or nest in as deep as they are long.
        (15, "ab-" * 20_000 + " " + "a." * 20_000 + " " + "- " * 5_000),
        (16, "x@" + "a." * 20_000 + " " + "x@a." * 5_000 + "com"),
        (17, "password=" * 5_000 + " " + "1" * 20_000 + " " + "Mr " * 5_000),
    ]
    rows = [(i, t, "en", "src", len(t or "")) + ("clash", "x", 1, "s", 2) + ("z",) * 27 for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
