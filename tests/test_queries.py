"""Every query with SQL gives DuckDB's rows; the entry runs."""

import duckdb
import pytest

import __spark_entry__ as contract
from fennwick.plans import queries as engine
from fennwick.plans import search_queries as searches
from fennwick.plans import source_queries as sources

QUERIES, SQL = engine.queries() | searches.queries() | sources.queries(), engine.oracle_sql() | searches.oracle_sql() | sources.oracle_sql()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(str([r[c] for c in cols]) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert mine == sorted(str([dict(zip(names, r))[c] for c in cols]) for r in found.fetchall())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_contract_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
