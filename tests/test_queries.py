"""Every registered query against its SQL on the smallest tables, rows compared without order."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from critmill.plans import queries as plans


@pytest.fixture(scope="module")
def engine(sf):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return v
    return float(f"{float(v):.9g}") if isinstance(v, (int, float, decimal.Decimal)) else v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, sf, engine, name):
    df = plans.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=key)
    r = engine.sql(plans.ORACLES[name])
    assert sorted(r.columns) == names
    at = [r.columns.index(n) for n in names]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() >= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
