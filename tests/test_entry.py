"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from colonnade import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def test_each_query_has_sql():
    assert set(engine.QUERIES) == set(engine.ORACLES)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, db, name):
    got = engine.QUERIES[name](spark, DATA)
    want = db.sql(engine.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    (row,) = e.entry(spark).collect()
    assert row.n > 0 and row.avg_suppkey == row.total // row.n
    assert set(e.oracle_sql()) <= set(e.queries())
