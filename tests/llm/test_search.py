"""Ranked search against every document scored by brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from partloom.llm import search


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def expected(documents, items, top=10):
    held = [Counter(terms(t)) for _, t in documents]
    lengths = [sum(c.values()) for c in held]
    total, filled = sum(lengths), sum(n > 0 for n in lengths)
    df = Counter(t for c in held for t in c)
    rows = []
    for name, text in items:
        wanted, scored = Counter(terms(text)), []
        for (doc_id, _), counts, n in zip(documents, held, lengths):
            score = 0
            for term, times in wanted.items():
                if tf := counts[term]:
                    weight = math.floor(1000 * math.log((2 * filled + 2) / (2 * df[term] + 1)))
                    m = 100 - 75 + (75 * n * filled) // total
                    score += times * weight * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, row in enumerate(sorted(scored)[:top], 1):
            rows.append((name, rank, row[3], -row[0]))
    return sorted(rows, key=str)


def found(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def corpus(seed):
    """Common and rare words, long and short texts, copies that tie."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "漢字", "x_y", "don't"]
    shares = [1 / (i + 1) for i in range(len(words))]
    some = lambda n: " ".join(rng.choices(words, shares, k=n))
    documents = [(i, some(rng.choice([0, 1, 3, 10, 40, 300]))) for i in range(250)]
    documents += [(1000 + i, "w50 w51 W52") for i in range(30)]
    documents += [(None, "w50 w51 w52"), (7, "w58 w59"), (7, "w58 w59"), (2000, None), (2001, "  ")]
    items = [(i, some(rng.choice([1, 2, 5, 30]))) for i in range(25)]
    items += [(100, "W50 w50 w51"), (101, None), (102, "--"), (103, "unknown"), (None, "w59 w3")]
    items += [(100, "w52"), (104, "w0 w0 w0 w0 w59")]
    return documents, items


@pytest.mark.parametrize("block,read,size", [(1 << 20, 16, 10**6), (40, 1, 200), (500, 3, 10**6)])
def test_brute_force(spark, monkeypatch, block, read, size):
    monkeypatch.setattr(search, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(search, "FIRST_READ", read)
    monkeypatch.setattr(search, "PASS_BYTES", size)
    documents, items = corpus(block)
    got = search.ranked(
        spark.createDataFrame(documents, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    assert found(got) == expected(documents, items)


def test_stops_before_the_ends_of_the_lists():
    """Long lists of low impact are left once no unseen document can be among the best."""
    n = 5000
    bounds = np.arange(0, 2 * n + 1, 2)
    codes = np.tile(np.array([0, 1], dtype=np.int32), n)
    counts = np.ones(2 * n, dtype=np.int32)
    counts[: 2 * 20] = 50
    lengths = np.full(n, 100)
    weight = np.array([500, 700])
    lists = search.Lists([*range(n)], lengths, bounds, codes, counts, weight, n, 100 * n)
    met = []
    look_up = lists.look_up
    lists.look_up = lambda new, times: met.extend(new.tolist()) or look_up(new, times)
    best = search.Best(10)
    lists.search(np.array([0, 1]), np.array([1, 1]), np.zeros(2, dtype=np.int64), best)
    assert best.documents == [*range(10)]
    assert set(range(10)) <= set(met) and len(met) < 100
    assert not lists.seen.any() and not lists.met.any()


def test_best_positions_jump_over_what_direct_access_has_seen():
    lists = search.Lists(
        [0, 1, 2], np.full(3, 10), np.array([0, 2, 4, 6]), np.array([0, 1] * 3, dtype=np.int32),
        np.array([9, 1, 5, 5, 1, 9], dtype=np.int32), np.array([10, 10]), 3, 30,
    )
    lists.look_up(np.array([0, 1]), np.array([1, 1]))
    assert lists._first_unseen(0, 3) == 2  # documents 0 and 1 lead the first list
    assert lists._first_unseen(3, 6) == 3  # document 2, unseen, leads the second


def test_edges_and_empty_tables(spark, edges, empty):
    items = [(1, "Word two"), (2, None), (3, "idiot"), (3, "漢字 line")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    benchmark = benchmark.selectExpr("*", "1 AS query", "'x' AS rank", "2 AS score", "3 AS part")
    texts = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    assert found(search.ranked(edges, benchmark)) == expected(texts, items)
    assert search.ranked(empty, benchmark).count() == 0
    assert search.ranked(edges, benchmark.limit(0)).count() == 0
