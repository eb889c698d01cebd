"""The pipeline stage by stage, on documents with planted cases and on awkward rows."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from partloom.llm.storage import written  # noqa: E402


def test_stages_and_what_they_decide(spark, small, documents):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    item = benchmark.first().text
    base = " ".join(f"word{i % 97}x{i // 97} the" for i in range(300))
    planted = spark.createDataFrame(
        [
            (900_000, base, "en", "s", 1),
            (900_001, base.replace(" the ", " zzz ", 1), "en", "s", 1),
            (900_002, f"Quite clean words in front of it. {item}. And {base[500:900]}", "en", "s", 1),
        ],
        documents.schema,
    )
    docs = documents.unionByName(planted)
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == documents.columns
        if name == "decontamination":
            left = docs.where("doc_id = 900002").first()
            assert left is None or item not in left.text
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "packing",
    ]
    assert all(later <= before for before, later in zip(ids, ids[1:]))
    assert len(ids[1]) > 0.9 * len(ids[0])
    assert 900_001 not in ids[3]
    assert ids[5] == ids[4]


def test_awkward_rows(spark, small, edges, empty):
    for frame in (edges, empty):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, small), name)
            if name != "packing":
                assert docs.columns == frame.columns
        docs.collect()


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() > 0 and "sequence_id" in rows.columns
