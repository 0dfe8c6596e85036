"""Every query that has SQL gives the same rows in DuckDB over the same files."""

import math

import duckdb
import pytest

from cadence.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, int)):
        return v
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    expect = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expect.columns)
    at = [expect.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in expect.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
