"""How much a task of a large step takes at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom import session
from workload import binding


def test_stored_tables_are_derived_by_small_tasks(spark, tmp_path, monkeypatch):
    """Not by tasks as large as the session has them, and the session's setting stays."""

    def counted(spark, sf_dir):
        return spark.range(200_000).groupBy("id").agg(F.count("*").alias("n"))

    monkeypatch.setitem(binding.DERIVED, "stock", counted)
    monkeypatch.setattr(session.small_tasks.__wrapped__, "__defaults__", (100_000,))
    first = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    spark.conf.set(first, "false")
    before = spark.conf.get(session.TASK_BYTES)
    try:
        rows = binding.table(spark, str(tmp_path), "stock")
    finally:
        spark.conf.unset(first)
    assert rows.count() == 200_000
    assert len(rows.inputFiles()) > 1
    assert spark.conf.get(session.TASK_BYTES) == before


def test_smaller_tasks_of_the_session_stay(spark):
    before = spark.conf.get(session.TASK_BYTES)
    spark.conf.set(session.TASK_BYTES, "8m")
    with session.small_tasks(spark):
        assert spark.conf.get(session.TASK_BYTES) == str(8 * 1024 * 1024)
    assert spark.conf.get(session.TASK_BYTES) == "8m"
    spark.conf.set(session.TASK_BYTES, before)
