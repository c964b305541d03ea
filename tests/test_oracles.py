"""Every query with an oracle against DuckDB on the given tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

from tidemark.plans import registry

DIR = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DIR).is_dir():
        pytest.skip("needs the given tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def shape(frame):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(one(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shape(got) == shape(want)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    small = "/root/testdata/sf0.001"
    if not Path(small).is_dir():
        pytest.skip("needs the given tables")
    assert registry.flagship(spark, small).count() > 0
