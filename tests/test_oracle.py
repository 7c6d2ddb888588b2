"""Every query with SQL against DuckDB on the smallest folder."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402

CORE = sorted(k for k in entry.oracle_sql() if not (k[0] == "p" and k[1].isdigit()))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    r = db.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(cols, r.fetchall())


def test_entry_and_names():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
