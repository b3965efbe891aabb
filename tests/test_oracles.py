"""Every query that has SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pandas as pd
import pytest
from textbastion.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v.tolist() if hasattr(v, "tolist") else v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    a, b = registry.QUERIES[name](spark, DIR).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
