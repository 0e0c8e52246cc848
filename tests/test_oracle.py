"""Every query against its SQL in DuckDB, over the smallest tables."""

import collections
import os

import duckdb
import pytest

from fluvia.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in sorted(os.listdir(FOLDER))] if os.path.isdir(FOLDER) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not TABLES, reason="no tables here")
@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    names = sorted(df.columns)
    got = collections.Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    cursor = duck.execute(SQL[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert got == collections.Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
