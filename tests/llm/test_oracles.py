"""Queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from inkstone.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DIR}/{t}'")
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = lambda found: sorted(map(str, found))
    got = registry.queries()[name](spark, DIR).select(*columns).collect()
    assert rows(tuple(r) for r in got) == rows(want.select(*columns).fetchall())
