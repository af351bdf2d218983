"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessellar.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def rows(df):
    cols = sorted(df.columns)
    text = lambda v: None if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) else str(v)
    return sorted((tuple(text(v) for v in r) for r in df[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())


def test_greedy_matches_use_each_side_once(spark):
    got = catalog.QUERIES["j18_greedy_iou_match"](spark, "/root/testdata/sf0.01").toPandas()
    assert not got.duplicated(["label", "a_id"]).any() and not got.duplicated(["label", "b_id"]).any()
