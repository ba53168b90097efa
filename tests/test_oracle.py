"""Every registered query equals its DuckDB oracle on the smallest data."""

import datetime as dt
import math

import pytest

from mailroom.plans import catalog

SMOKE = "/root/testdata/sf0.001"

BASE = ["events", "documents", "conversations", "pages", "benchmark", "labels"]


def _norm(v):
    if v is None:
        return ("", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float)):
        return ("f", "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 9)))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    return ("s", str(v))


def _rows(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(t[i]) for i in order) for t in tuples)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, duck, key):
    df = catalog.QUERIES[key](spark, SMOKE)
    srows = [tuple(r) for r in df.collect()]
    r = duck.execute(catalog.ORACLE[key])
    dcols = [d[0] for d in r.description]
    drows = r.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(df.columns, srows) == _rows(dcols, drows)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert "status" in df.columns
