"""Prefix tries against nodes found by listing every prefix."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from partloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """The turns of each conversation, as the operator orders them."""
    def key(turn, role, text):
        raw = f"{len(role.encode())}:{role}{text}".encode()
        return (turn is not None, turn or 0, hashlib.sha256(raw).hexdigest())

    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            found[conv].append((key(turn, role, text), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in found.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def expected(turns):
    members = defaultdict(list)
    for c, own in turns.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    rows = []
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(convs) - 1) * words
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(turns[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        counts = (len(convs), children[node], leaves[node], saved[node])
        end = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(convs), len(node), parent, *counts, end))
    return sorted(rows, key=str)


def found(frame):
    return sorted((tuple(r[c] for c in tries.RESULT) for r in frame.collect()), key=str)


def conversations(seed, n=150):
    """Few different turns, so that prefixes branch; some long ones, copies, and gaps."""
    rng = random.Random(seed)
    says = [("user", "hi"), ("user", "hi there you"), ("bot", ""), (None, None), ("ü", "漢 字 x")]
    rows = []
    for c in rng.sample(range(-40, 400), n):
        size = rng.choice([1, 1, 2, 3, 4, 9]) if rng.random() < 0.95 else 60
        steps = [rng.choice(says[: rng.choice([1, 2, 5])]) for _ in range(size)]
        if rng.random() < 0.3:
            steps = [says[0], says[1], says[2]]
        rows += [(c, i if rng.random() < 0.9 else None, *step) for i, step in enumerate(steps)]
    rows += [(None, 0, "user", "of no conversation"), (900, 5, "b", "x"), (900, 5, "a", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 19])
def test_brute_force(spark, block):
    rows = conversations(block)
    frame = spark.createDataFrame(rows, SCHEMA)
    turns = ordered(rows)
    assert found(tries.trie(tries.sequences(frame), block)) == expected(turns)
    again = tries.trie(tries.regrafted(tries.sequences(frame)), block)
    assert found(again) == expected(rebuilt(turns))


def test_many_ends_at_one_node(spark):
    rows = [(c, 0, "user", "the same") for c in range(3000)]
    rows += [(c, 1, "bot", "and more words") for c in range(0, 3000, 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(tries.trie(tries.sequences(frame), 500)) == expected(ordered(rows))


def test_extents_by_halving():
    """Both searches against a look at every neighbour."""
    rng = random.Random(5)
    paths = sorted([rng.randrange(2) for _ in range(rng.randrange(6))] for _ in range(200))
    bounds = np.cumsum([0, *map(len, paths)])
    keys = np.array([[k, 7] for p in paths for k in p], dtype=np.uint64).reshape(-1, 2)
    block = tries.Block(np.arange(200)[::-1].copy(), bounds, keys, np.ones(len(keys), dtype=np.int64))
    for i, path in enumerate(paths):
        for d in range(1, len(path) + 1):
            same = [j for j, other in enumerate(paths) if other[:d] == path[:d]]
            at, depth = np.array([i]), np.array([d])
            assert block._left(at, depth)[0] == same[0]
            assert block._right(at, depth)[0] == same[-1]
    assert sorted(zip(block.left, block.depth)) == [*zip(block.left, block.depth)]


def test_edges_and_empty_tables(spark):
    long_text = "word " * 200_000
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "", ""), (3, 0, "user", long_text)]
    rows += [(None, None, None, None), (23, 1, "a", ""), (4, 3, "x", "a\0b"), (4, 3, "x", "a\0b")]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS part", "2 AS turns", "'n' AS kind", "'p' AS prefix", "0 AS depth", "'s' AS stem"
    )
    turns = ordered(rows)
    assert found(tries.trie(tries.sequences(clash))) == expected(turns)
    assert found(tries.trie(tries.regrafted(tries.sequences(clash)))) == expected(rebuilt(turns))
    assert tries.trie(tries.sequences(clash.limit(0))).count() == 0
