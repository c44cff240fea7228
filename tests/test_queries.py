"""Every query with an SQL twin against DuckDB on the smallest tables; the others for rows and stable columns."""

import os

import duckdb
import pytest

from tallybook.plans import audit, coverage, finance, more, pages, records

ALL = {**finance.QUERIES, **records.QUERIES, **more.QUERIES, **coverage.QUERIES, **pages.QUERIES, **audit.QUERIES}
SQL = {**finance.ORACLES, **records.ORACLES, **more.ORACLES, **coverage.ORACLES, **pages.ORACLES, **audit.ORACLES}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def _plain(v):
    if v is None or v != v:
        return "None"
    return str(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf, duck, name):
    df = ALL[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in SQL:
        want = duck.sql(SQL[name])
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
