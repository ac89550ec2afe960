"""Every structure query with SQL gives what DuckDB gives, on the smallest tables; skipped where they aren't there."""

import os

import duckdb
import pytest

from residua import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DIR}/{t}'")
    return con


def key(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(format(r[i], ".10g") if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_duckdb(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    want = duck.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, DIR).columns
