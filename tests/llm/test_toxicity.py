"""The factorization machine: held-out documents, pairs of terms, edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm import toxicity as t

LARGER = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_documents(spark):
    documents = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    machine = t.train(t.labelled_texts(documents, labels))
    unseen = t.scores(documents, machine).where(t.held_out(F.col("doc_id"))).join(labels, "doc_id")
    rows = unseen.select("score", "toxic").collect()
    scores, marks = (np.array(x, dtype=float) for x in zip(*rows))
    assert len(rows) > 500 and auc(scores, marks) > 0.94
    assert ((scores >= 0.5) & (marks == 0)).sum() <= 3


def test_pairs_that_no_sum_of_weights_can_tell():
    """Two terms are toxic together and harmless alone, each as often as not."""
    rng = np.random.default_rng(0)
    examples, labels = [], []
    for _ in range(1200):
        insult, group = rng.random(2) < 0.5
        noise = 10 + rng.choice(20, 5, replace=False)
        examples.append(np.sort(np.append(noise, [1] * int(insult) + [2] * int(group))).astype(np.int64))
        labels.append(float(insult and group))
    machine = t.fit(examples, np.array(labels))
    pairs = [np.array(x, dtype=np.int64) for x in ([], [1], [2], [1, 2])]
    none, one, two, both = (machine.margins(np.zeros(len(p), int), p, 1)[0] for p in pairs)
    assert both > 0 > max(one, two, none)
    assert both - one - two + none > 0.05


def test_labels_all_alike_or_none():
    machine = t.fit([np.array([1, 2]), np.array([3])], np.array([0.0, 0.0]))
    assert t.sigmoid(machine.margins(np.zeros(0, int), np.zeros(0, int), 1))[0] < 0.5
    machine = t.fit([], np.zeros(0))
    assert t.sigmoid(machine.margins(np.zeros(0, int), np.zeros(0, int), 1))[0] == pytest.approx(0.5)


def test_edges(spark, edges, empty):
    labels = spark.createDataFrame(
        [(14, 1, 1), (1, 1, 0), (1, 0, None), (None, 1, 1), (9, 1, 0), (9, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    training = t.labelled_texts(edges, labels)
    machine = t.train(training)
    rows = t.scores(edges, machine).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    kept = t.without_toxic(edges, machine)
    assert kept.columns == edges.columns
    none = t.train(t.labelled_texts(empty, labels))
    assert t.scores(empty, none).count() == 0
    assert t.scores(edges, none).count() == edges.count()


def test_sample_is_bounded(documents, spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    machine = t.train(t.labelled_texts(documents, labels), rows=30)
    assert len(machine.slots) < 1000
