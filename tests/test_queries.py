"""Every query of the library against DuckDB on the smallest tables, and the rest by their own checks."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from notewright.queries import ORACLE, QUERIES
from notewright.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        v = float(v)
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    return v


# Values of the queries without SQL are tested in test_tools.py; here they must run over the whole tables.


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    d = QUERIES[name](spark, SF)
    cols = sorted(d.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in d.collect())
    r = duck.sql(ORACLE[name])
    at = [r.columns.index(c) for c in cols]
    assert sorted(r.columns) == cols
    want = sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
