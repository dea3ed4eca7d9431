"""Every query of the engine against its SQL, over whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from textlode.plans.queries import ORACLES, QUERIES

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(table):
    return sorted((tuple("\0" if v is None or isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in table))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got.select(*columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
