"""Queries of the llm folder against their DuckDB statements, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from corpuslens.llm.oracles import oracle_sql
from corpuslens.llm.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_statement(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries()[name](spark, SF)
    expected = duck.execute(oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in sorted(names)) for r in df.collect()) == Counter(
        tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in expected.fetchall())
