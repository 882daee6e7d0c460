"""Every query with SQL equals DuckDB's result on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from meshflow.plans import registry, streams  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(None if pd.isna(x) else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)]
    return sorted(df.columns), sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    mine, theirs = tidy(registry.QUERIES[name](spark, SF).toPandas()), tidy(duck.execute(registry.ORACLE_SQL[name]).df())
    assert mine == theirs


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
