"""Benchmark passages against brute force."""

from __future__ import annotations

import random
import re

import pytest

from partloom.llm import contamination as c


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def expected(text, items, width):
    tokens = words(text)
    hit, names = set(), set()
    for name, item in items:
        w = words(item)
        spans = [w[i : i + width] for i in range(len(w) - width + 1)] or ([w] if w else [])
        for span in spans:
            for i in range(len(tokens) - len(span) + 1):
                if tokens[i : i + len(span)] == span:
                    hit |= set(range(i, i + len(span)))
                    if name is not None:
                        names.add(str(name))
    return len(tokens), len(hit), sorted(names)


def found(frame):
    return [(r.n_words, r.n_hit, r["items"]) for r in frame.collect()]


@pytest.fixture(scope="module")
def pair(spark):
    """Texts over few words, so that items overlap themselves and each other."""
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 6, 9, 14]))) for i in range(2, 14)]
    items += [(1, "Solo"), (None, "named nobody, here at all"), (20, None), (21, " -- ")]
    items += [(22, items[-5][1]), (23, items[-5][1])]
    texts = [(i, some(rng.randrange(0, 60))) for i in range(60)]
    texts += [(90, "named! Nobody HERE at, all solo"), (91, None), (92, "")]
    return texts, items


@pytest.mark.parametrize("block_words", [10, 10**6])
def test_brute_force(spark, monkeypatch, pair, block_words):
    texts, items = pair
    monkeypatch.setattr(c, "BLOCK_WORDS", block_words)
    documents = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = found(c.contamination(documents, benchmark, 5))
    assert got == [expected(t, items, 5) for _, t in texts]


def test_passages_are_cut(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away today"
    clean = "nothing to see in this text, which has other words"
    rows = [
        (1, f"Before it. {item.title()}, and after — ünd ßo. {clean}", 7),
        (2, item, 7),
        (3, clean, 7),
        (4, None, None),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in c.decontaminate(documents, benchmark).collect()}
    left = f"Before it. , and after — ünd ßo. {clean}"
    assert got == {1: (left, len(left)), 3: (clean, 7), 4: (None, None)}


def test_edges_and_empty_tables(spark, edges, empty):
    benchmark = spark.createDataFrame([(1, "Word"), (2, None)], "item_id long, text string")
    got = c.contamination(edges, benchmark)
    assert got.count() == edges.count()
    assert {r.doc_id for r in got.collect() if r.n_hit} == {None, 1, 5, 7}
    assert c.contamination(edges, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert c.contamination(empty, benchmark).count() == 0
    kept = c.decontaminate(edges, benchmark)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 1  # the one-word text
