"""Every registered query with an oracle agrees with DuckDB at sf0.001."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["embeddings", "pages", "documents", "labels"]


def canon(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if (x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)))
                         else (round(float(x), 6) if isinstance(x, float) else (x.item() if hasattr(x, "item") else x))
                         for x in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF).toPandas()
    o = con.sql(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert canon(s) == canon(o)


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["page_id", "body"]
    assert df.count() > 0
