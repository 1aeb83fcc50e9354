"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from graphloom.plans import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()


def canon(rows, columns):
    cell = lambda v: "~" if v is None or v != v else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(oracles.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    names = list(want.columns)
    assert canon([r.asDict() for r in df.collect()], columns) == canon([dict(zip(names, r, strict=True)) for r in want.fetchall()], columns)


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
