"""Means of occupancies that only doubles tell apart: 2.01 / 3 is under 0.67, so it doesn't tie with one atom of 0.67."""

import duckdb
import pytest

from residua import queries as Q

COLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Twelve entries with a residue of three atoms of one label and one atom of the other, all of occupancy 0.67."""
    rows = []
    for e in range(1, 13):
        three, one = ("F", "O") if e % 2 else ("O", "F")
        b = 1 if e % 8 < 4 else 9
        rows += [(e, k, 2, k, b if k < 4 else 5, 1.0, 0.33, 0.01, "R" if e % 3 else "A", three if k < 4 else one, "1995-01-01") for k in range(1, 5)]
    d = tmp_path_factory.mktemp("ties")
    values = ", ".join(str(r) for r in rows)
    duckdb.connect().execute(f"copy (select * replace (CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, CAST(l_shipdate AS DATE) AS l_shipdate) from (values {values}) t({COLS})) to '{d}/lineitem.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["altloc_best_occ_first", "altloc_best_occ_high_b", "altloc_best_occ_last", "altloc_best_occ_low_b", "altloc_mapping", "canonical_pipeline"])
def test_means_are_doubles(spark, lines, name):
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{lines}/lineitem.parquet'")
    got = Q.QUERIES[name](spark, lines)
    want = con.execute(f"select {', '.join(got.columns)} from ({Q.ORACLES[name]})").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
