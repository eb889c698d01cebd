"""Near duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from partloom.llm import near_dups
from partloom.llm.components import components


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) >= width:
        return frozenset(zip(*[words[i:] for i in range(width)]))
    return frozenset([tuple(words)]) if words else frozenset()


def expected(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_all_pairs(documents, texts, width, percent):
    assert found(near_dups.near_duplicates(documents, width, percent)) == expected(
        texts, width, percent
    )


def varied(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_large_groups_branch_and_are_dealt_to_blocks(spark, monkeypatch):
    """One large group of near copies, and some that miss the threshold."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {i: varied(rng, base, rng.choice([0, 1, 2, 3, 4])) for i in range(260)}
    texts |= {1000 + i: varied(rng, base, 40) for i in range(40)}
    other = [f"v{i}" for i in range(90)]
    texts |= {2000 + i: varied(rng, other, 1) for i in range(30)}
    monkeypatch.setattr(near_dups, "LEAF", 32)
    monkeypatch.setattr(near_dups, "BLOCK", 128)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(near_dups.near_duplicates(frame, 3, 85)) == expected(texts, 3, 85)


def test_pairs_inside_a_large_group_of_look_alikes(spark, monkeypatch):
    """A template group whose members miss the threshold but for some pairs and a chain."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(300):
        words = list(base)
        at = rng.randrange(100)
        words[at : at + rng.choice([5, 14])] = [f"own{i}x{k}" for k in range(rng.choice([10, 14]))]
        texts[i] = " ".join(words)
        if i % 5 == 0:
            texts[1000 + i] = " ".join([*words, "tail", f"of{i}"])
    for i in range(40):
        texts[5000 + i] = " ".join([*base, *[f"step{k}" for k in range(i, i + 20)]])
    monkeypatch.setattr(near_dups, "LEAF", 4)
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    monkeypatch.setattr(near_dups, "LEVELS", 1)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(near_dups.near_duplicates(frame, 3, 85)) == expected(texts, 3, 85)


def test_edges(edges):
    rows = near_dups.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by_id[2] == by_id[3][:1] + [] or by_id[2] == [(0, 2, True)]
    assert by_id[4] == [(0, 4, True)]
    assert by_id[5] == [(1, 5, True)]
    assert by_id[7] == [(by_id[1][0][0], 1, False)] * 2
    assert {x[1] for x in by_id[8]} == {8}
    assert {x[1:] for x in by_id[None]} <= {(None, True)}
    assert by_id[10][0][1] == 9


def test_empty(empty):
    assert near_dups.near_duplicates(empty).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components(frame).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}


def test_texts_are_never_broadcast(documents):
    plan = near_dups.near_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert documents.select(F.max("doc_id")).first()[0] is not None


def test_texts_that_none_compares_are_not_shuffled(spark, monkeypatch):
    """Marked texts hold all that are wanted, and few others unless the bits are few."""
    texts = spark.createDataFrame(
        [(i, f"text {i}") for i in range(-500, 500)] + [(7, "again"), (None, "none")],
        "doc_id long, text string",
    )
    wanted = spark.range(0, 500, 7).select(F.col("id").alias("doc_id"))
    marked = near_dups._marked(texts, wanted)
    assert "ObjectHashAggregate" not in marked._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.text) for r in marked.collect())
    assert got == sorted([(i, f"text {i}") for i in range(0, 500, 7)] + [(7, "again")])
    joined = near_dups._only(texts, wanted.distinct())
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    assert sorted((r.doc_id, r.text) for r in joined.collect()) == got
    monkeypatch.setattr(near_dups, "MARKS", 128)
    more = {r.doc_id for r in near_dups._marked(texts, wanted).collect()}
    assert set(range(0, 500, 7)) <= more


def test_blocks_find_shared_members_in_one_reduction(spark):
    large = spark.range(900).selectExpr(
        "id % 2 AS node", "id AS doc_id", "450L AS size", "5000000L AS weight"
    )
    blocks = near_dups._blocks(large)
    plan = blocks._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("min_by") and plan.count("HashAggregate") + plan.count("SortAggregate") <= 6
    rows = {}
    for r in blocks.collect():
        rows.setdefault(r.node, []).append(r.doc_id)
    assert all(len(ids) == len(set(ids)) for ids in rows.values())
    for side in (0, 1):
        own = [set(ids) for ids in rows.values() if ids[0] % 2 == side]
        assert set.union(*own) == set(range(side, 900, 2))
        assert len(set.intersection(*own)) >= near_dups.PIVOTS // 2


def test_stars_need_no_further_round(spark, monkeypatch):
    def fail(links):
        raise AssertionError("stars were contracted again")

    frame = spark.createDataFrame([(9, 1), (1, 4), (1, 9), (3, 3), (2, 8)], "a long, b long")
    monkeypatch.setattr("partloom.llm.components._large_star", fail)
    assert {r.id: r.component for r in components(frame).collect()} == {1: 1, 4: 1, 9: 1, 2: 2, 8: 2}
