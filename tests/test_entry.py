"""The driver's contract: every query runs, and those with an SQL twin give the same rows."""

import decimal
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def test_names():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 80


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE:
        r = db.execute(ORACLE[name])
        have = [d[0] for d in r.description]
        assert sorted(have) == cols
        assert rows == sorted(tuple(plain(x[have.index(c)]) for c in cols) for x in r.fetchall())
