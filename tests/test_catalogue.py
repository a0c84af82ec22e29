"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quern.plans import catalogue

SF = os.environ.get("QUERN_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def test_all_have_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    a = sorted([repr([plain(r[c]) for c in columns]) for r in ours.collect()])
    b = sorted([repr([plain(r[i]) for i in at]) for r in theirs.fetchall()])
    assert a == b
