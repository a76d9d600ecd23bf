"""The operators that SQL can express, against their SQL."""

import duckdb
import pandas as pd
import pytest

from plumbline.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # A column of integers with nulls comes as one of doubles from one side.
    cell = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
