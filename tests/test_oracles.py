"""Every registered query against its DuckDB statement, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from corpuslens.registry.oracles import oracle_sql
from corpuslens.registry.queries import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")
QUERIES, STATEMENTS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def _counts(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_statement(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    expected = duck.execute(STATEMENTS[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert _counts(df.columns, rows) == _counts(names, expected.fetchall())


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


def test_entry_holds_every_query():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(STATEMENTS) <= set(entry_point.oracle_sql())


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["query_id", "rank", "path", "snippet", "score", "source"]
    assert all(math.isfinite(r["score"]) for r in df.collect())
