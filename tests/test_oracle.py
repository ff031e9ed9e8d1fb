"""Registered queries against their DuckDB SQL on the smallest tables (the driver
runs the same comparison at sf0.01)."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from cumulus.plans.catalog import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def norm(v):
    if isinstance(v, float):
        return ("f", repr(v)) if not math.isnan(v) else ("f", "nan")
    if isinstance(v, (dt.date, dt.datetime)):
        return ("d", v.isoformat())
    if v is None:
        return ("n", "")
    return ("v", str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, srows) == canon(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["country", "quarter", "quarter_total_confirmed", "quarter_total_confirmed_percent"]
    assert df.count() > 0


def test_every_oracle_stores_as_a_view(con):
    for i, key in enumerate(sorted(QUERIES)):
        con.sql(entry.oracle_sql()[key]).create_view(f"o{i}")


def test_reset_derives_anew(spark):
    from cumulus.plans import catalog

    first = catalog.fx.places(spark, SF_SMALL)
    assert catalog.fx.places(spark, SF_SMALL) is first
    catalog.reset()
    assert catalog.fx.places(spark, SF_SMALL) is not first
