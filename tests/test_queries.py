"""Every query with a SQL twin gives the twin's rows; every other query runs."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(ROOT).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, ROOT)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert sorted(tuple(plain(x) for x in r) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).columns
