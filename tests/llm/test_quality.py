"""Base counts against brute force, and the estimation against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from partloom.llm import quality as q

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        failed,
    )


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def flat(frame):
    return frame.select("doc_id", "text", *[f"m.{c}" for c in FIELDS], "base_failed", "kept")


def test_base_counts(documents):
    for r in flat(q.judged(documents)).collect():
        assert tuple(r[2:8]) == base(r.text)


def test_edges(edges, empty):
    judged = q.judged(edges)
    rows = flat(judged).collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert tuple(r[2:8]) == base(r.text)
        assert r.kept is not None and not (r.kept and r.base_failed)
    assert q.judged(empty).count() == 0
    assert {"node", "score", "text"} <= set(judged.columns)


def fold(patterns, rules, rounds):
    """The same estimation, written as loops."""
    bias = q.START_BIAS
    weights = [(q.START_AGAINST, q.START_FOR)] * rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        post = []
        for votes, _ in patterns:
            said = sum(w[0] if v < 0 else w[1] if v > 0 else 0 for v, w in zip(votes, weights))
            post.append(1 / (1 + math.exp(-(bias + said))))
        good = sum(n * p for (_, n), p in zip(patterns, post))
        bad = sum(n * (1 - p) for (_, n), p in zip(patterns, post))

        def weight(j, vote, limits):
            same = [(n, p) for (votes, n), p in zip(patterns, post) if votes[j] == vote]
            a = (sum(n * p for n, p in same) + 0.5) / (good + 1.5)
            b = (sum(n * (1 - p) for n, p in same) + 0.5) / (bad + 1.5)
            return max(limits[0], min(limits[1], math.log(a / b)))

        weights = [(weight(j, -1, q.AGAINST), weight(j, 1, q.FOR)) for j in range(rules)]
        share = min(q.MOST_SHARE, max(q.LEAST_SHARE, good / total))
        bias = math.log(share / (1 - share))
    return bias, weights


def test_estimation(documents):
    voted = q.votes(q.measures(documents))
    model = q.estimate(voted)
    counted = voted.groupBy("votes").count().collect()
    bias, weights = fold(sorted((list(r.votes), r["count"]) for r in counted), len(q.RULES), q.ROUNDS)
    assert math.isclose(model["bias"], bias, rel_tol=1e-9)
    for got, wanted in zip(model["weights"], weights):
        assert math.isclose(got["against"], wanted[0], rel_tol=1e-9)
        assert math.isclose(got["for"], wanted[1], rel_tol=1e-9)


def test_agrees_with_labels_it_never_saw(spark):
    """Junk goes and good documents stay, but for those that fail the base rules."""
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = q.judged(documents).join(labels, "doc_id").select("quality", "base_failed", "kept")
    rows = rows.collect()
    junk = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(junk) < 0.05 * len(junk) and sum(good) > 0.97 * len(good)


def test_one_vote_against_does_not_reject(empty):
    """An empty table keeps the start, by which one vote against many is outweighed."""
    model = q.estimate(q.votes(q.measures(empty)))
    assert model["bias"] == q.START_BIAS
    assert [tuple(w) for w in model["weights"]] == [(q.START_AGAINST, q.START_FOR)] * len(q.RULES)
    said = q.START_AGAINST + (len(q.RULES) - 1) * q.START_FOR
    assert q.START_BIAS + said > 0 > q.START_BIAS + said + q.START_AGAINST - q.START_FOR


def test_plan_is_native(documents):
    plan = q.judged(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
