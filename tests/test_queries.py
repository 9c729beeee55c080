"""Every catalogue query with an oracle equals DuckDB on the smallest tables."""

import math
import os

import pytest

from larkspool.plans.catalogue import ORACLES, QUERIES

DATA = os.environ.get("LARKSPOOL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(rows, cols):
    return sorted((tuple(tidy(r[c]) for c in sorted(cols)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of([r.asDict() for r in got.collect()], got.columns) == rows_of([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
