"""Source mixes against a plain queue."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from partloom.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(sizes, weights, budget, repeats):
    """Shares reshared until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = budget - sum(repeats * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        for s in names:
            target[s] = (
                Fraction(repeats * sizes[s]) if s in full else Fraction(left * weight[s], open_weight)
            )
        above = {s for s in names if s not in full and target[s] > repeats * sizes[s]}
        if not above:
            return target
        full |= above


def expected(rows, weights, percent=100, repeats=3):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += n_words(text)
    budget = sum(sizes.values()) * percent // 100
    target = expected_targets(sizes, weights, budget, repeats)
    names = sorted(sizes, key=lambda s: (s is None, s))
    draw = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    order = sorted(
        range(len(rows)), key=lambda r: (draw(rows[r][0]), rows[r][0] or 0, n_words(rows[r][1]))
    )
    reach, queue = defaultdict(int), []
    for r in order:
        _, text, source = rows[r]
        size = n_words(text)
        reach[source] += size
        for copy in range(repeats if size else 0):
            end = copy * sizes[source] + reach[source]
            queue.append((end / float(target[source]), names.index(source), copy, end, r, size))
    taken, left = [0] * len(rows), budget
    for *_, r, size in sorted(queue):
        use = min(size, left)
        taken[r] += use
        left -= use
    return [
        (rows[r][0], n_words(rows[r][1]), sizes[rows[r][2]], float(target[rows[r][2]]), taken[r])
        for r in range(len(rows))
    ]


def found(frame):
    rows = [(r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in frame.collect()]
    return sorted(rows, key=str)


def close(got, want):
    want = sorted(want, key=str)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], rel=1e-12)


SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("seed,percent", [(1, 100), (2, 100), (3, 40), (4, 250)])
def test_brute_force(spark, seed, percent):
    rng = random.Random(seed)
    names = ["a", "b", "Z", "é", "\U0001f642", None, "", "mid", "hot"]
    rows = []
    for i in range(400):
        source = "hot" if rng.random() < 0.4 else rng.choice(names)
        size = rng.choice([0, 1, 2, 5, 20, rng.randrange(200)])
        rows.append((i, " ".join(["w"] * size), source))
    rows += [(500, None, "nothing"), (501, "", "nothing"), (502, "x " * 3000, "one document")]
    frame = spark.createDataFrame(rows, SCHEMA)
    close(found(mixing.mixed(frame, (5, 2, 1), percent)), expected(rows, (5, 2, 1), percent))


def test_targets_are_met_within_a_document(spark, documents):
    rows = mixing.mixed(documents).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    assert sum(r.taken for r in rows) == sum(r["size"] for r in rows)
    for own in by_source.values():
        slack = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= slack


def test_reruns_and_layouts_agree(spark, documents):
    first = found(mixing.mixed(documents))
    assert found(mixing.mixed(documents.repartition(7, "text"))) == first


def test_all_that_there_is(spark):
    rows = [(1, "a b", "x"), (2, "c", "y")]
    got = found(mixing.mixed(spark.createDataFrame(rows, SCHEMA), percent=1000))
    assert [r[4] for r in got] == [6, 3]


def test_edges_and_empty_tables(spark, edges, empty):
    got = mixing.mixed(edges).collect()
    assert len(got) == edges.count()
    assert sum(r.taken for r in got) == sum(r["size"] for r in got)
    assert mixing.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (None, " ", "s")], SCHEMA)
    assert {(r.taken, r.target) for r in mixing.mixed(blank).collect()} == {(0, 0.0)}
