"""Every engine query with SQL against DuckDB over the smallest test tables."""

import math
from pathlib import Path

import duckdb
import pytest

from marketweave.plans import live_queries, queries

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = oracle.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    place = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[p]) for p in place) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    df = queries.QUERIES[name](spark, str(FOLDER))
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["screen_value_growth", "screen_pe_growth", "screen_margin", "screen_small_profitable", "guarded_sql"])
def test_screens_keep_some_tickers_and_drop_some(oracle, name):
    assert 0 < len(oracle.execute(queries.SQL[name]).fetchall()) < 25


def test_live_queries_are_registered():
    assert live_queries.query is queries.query and "stream_rolling" in queries.QUERIES
