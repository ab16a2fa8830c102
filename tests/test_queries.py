"""Every registered query runs; those with SQL equal it in DuckDB."""

import math
import os

import duckdb
import pytest

from inkstone.plans import catalog

DIR = "/root/testdata/sf0.001"


def canonical(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(x) for x in r) for r in df.select(*columns).collect())
    if name in catalog.oracle_sql():
        want = con.sql(catalog.oracle_sql()[name])
        assert sorted(want.columns) == columns
        assert got == sorted(tuple(canonical(x) for x in r) for r in want.select(*columns).fetchall())


def test_flagship(spark):
    assert catalog.flagship(spark, DIR).count() > 0
