"""Lookups beyond the broadcast size, and ids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from partloom.operators import joins
from partloom.operators.keys import assign_ids


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the facts share a key, a tenth has none."""
    key = (
        F.when(F.col("id") % 2 == 0, "hot")
        .when(F.col("id") % 10 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")))
    )
    facts = spark.range(20_000).select(key.alias("k"), F.col("id").alias("fact"))
    names = spark.range(500).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("dim")
    )
    hot = spark.createDataFrame([("hot", -1)], "k string, dim long")
    return facts, names.unionByName(hot)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_is_the_same_on_either_path(skewed, how):
    facts, dimension = skewed
    small = joins.lookup(facts, dimension, ["k"], how)
    large = joins.lookup(facts, dimension, ["k"], how, max_bytes=0)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert small.columns == large.columns
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0


def test_hot_facts_are_spread(skewed):
    facts, dimension = skewed
    hot = joins.hot_keys(facts, ["k"])
    assert {row.k for row in hot} == {"hot", None}
    large = joins.lookup(facts, dimension, ["k"], "inner", max_bytes=0).where("k = 'hot'")
    assert large.count() == 10_000


def test_semi_and_anti(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, k string")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert [r.i for r in joins.having(left, right, ["k"]).collect()] == [1]
    assert {r.i for r in joins.lacking(left, right, ["k"]).collect()} == {2, 3}


def test_size_of_nested_values(spark):
    lists = spark.range(10).select(F.sequence(F.lit(1), F.lit(100_000)).alias("values"))
    assert joins.size_in_bytes(lists) > 10 * 100_000 * 8


def test_ids_are_unique_stable_and_above_those_taken(spark):
    rows = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("nume"))
    first = {r.nume: r.i for r in assign_ids(rows, ["nume"], "i").collect()}
    again = {r.nume: r.i for r in assign_ids(rows.repartition(7), ["nume"], "i").collect()}
    assert first == again
    assert len(set(first.values())) == 5000 and min(first.values()) >= 1
    taken = spark.createDataFrame([(10**6,)], "i long")
    later = [r.i for r in assign_ids(rows, ["nume"], "i", taken).collect()]
    assert min(later) > 10**6 and len(set(later)) == 5000
    empty = spark.createDataFrame([], "i long")
    assert {r.i for r in assign_ids(rows, ["nume"], "i", empty).collect()} == set(first.values())
