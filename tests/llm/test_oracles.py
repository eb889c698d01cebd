"""Registered corpus queries against their DuckDB SQL."""

from __future__ import annotations

import duckdb
import pytest

from partloom.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", SQL)
def test_query_matches_its_sql(spark, small, duck, name):
    result = QUERIES[name](spark, small)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(result.columns)
    order = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=order)
    assert got == sorted(expected.fetchall(), key=order)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_the_others_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
