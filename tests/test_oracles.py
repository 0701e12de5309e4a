"""Every query that has SQL gives the SQL's rows on the smallest tables; every other one runs."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from barloom.plans import bars

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if x is None or x is pd.NA or x != x else f"{x:.5f}" if isinstance(x, float) else f"{float(x):.5f}" if isinstance(x, int) and not isinstance(x, bool) else str(x) for x in (v.item() if hasattr(v, "item") else v for v in r)))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(bars.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in bars.SQL:
        want = duck.sql(bars.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
