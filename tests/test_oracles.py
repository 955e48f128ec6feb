"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if n in SQL]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    con.execute(SQL[name])
    want_cols = [x[0] for x in con.description]
    want = [tuple(map(plain, r)) for r in con.fetchall()]
    assert sorted(df.columns) == sorted(want_cols)
    got = [tuple(plain(r[c]) for c in want_cols) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(got) > 0 and len(set(got)) > 1
