"""Every query of the engine against its DuckDB SQL on the smallest tables that give it rows, order and all types of values included."""

import os

import duckdb
import pytest

from tidewell.plans import catalog

#: The second is for queries that have no rows in the first.
SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ROWS_ONLY = {"anomaly_audit", "learn_thresholds", "merged_episodes", "presence_walk", "stream_presence"}


def connected(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return c


@pytest.fixture(scope="module")
def duck():
    return {sf: connected(sf) for sf in (SF, LARGER)}


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def test_only_folds_have_no_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    for sf in (SF, LARGER):
        df = catalog.QUERIES[name](spark, sf)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
        if name in ROWS_ONLY:
            assert columns
            return
        cursor = duck[sf].execute(catalog.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        assert got == want
        if got:
            return
