"""Every registered mail query that has SQL, side by side with DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__
from quillstack.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, db, name):
    want = db.sql(SQL[name])
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*(f"`{c}`" for c in want.columns)).collect())
    assert got == sorted(tuple(map(str, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_beyond_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(QUERIES) <= set(__spark_entry__.queries())
