"""Reductions whose rows one task may unpack without bound."""

from __future__ import annotations

from partloom.operators import specs


def test_texts_are_dealt_before_they_are_sorted(spark):
    """The texts that one task unpacks are not sorted by it, and an item's texts meet."""
    texts = spark.range(300, numPartitions=1).selectExpr(
        "'memory' AS category",
        "id % 100 AS item_id",
        "'n' || id % 100 AS name",
        "'$1' AS price_text",
        "CAST(id AS INT) AS position",
        "CASE WHEN id < 200 THEN 'Color' ELSE 'CAS Latency' END AS label",
        "CAST(id AS STRING) AS value",
    )
    items = specs.gathered(texts)
    plan = items._jdf.queryExecution().sparkPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert plan.index("REPARTITION") > plan.index(lowest)
    got = {r.item_id: dict(r._texts) for r in items.collect()}
    assert got == {
        i: {"color": str(100 + i), "cas_latency": str(200 + i)} for i in range(100)
    }
