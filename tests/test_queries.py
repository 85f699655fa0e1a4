"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _rows(rows):
    out = []
    for r in rows:
        out.append(tuple("null" if v is None else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = [want.columns.index(c) for c in cols]
    assert _rows(got.select(*[f"`{c}`" for c in cols]).collect()) == _rows([[r[i] for i in order] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
