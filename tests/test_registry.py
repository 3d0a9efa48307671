"""Every registered query against its oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidegauge.operators import load_all
from tidegauge.plans.views import TABLES
from tidegauge.registry import ORACLES, QUERIES

load_all()
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes, dict)):
        return [str(plain(x)) for x in v]
    return str(v.item()) if hasattr(v, "item") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
