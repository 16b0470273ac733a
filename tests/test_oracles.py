"""Every query against its SQL twin over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarry.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        return "" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["chunk_language", "cap_length", "split_over_limit", "chunk_markdown", "hybrid", "near_text"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
