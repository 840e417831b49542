"""Every query of the main library against its SQL, over whole tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpusmetrics.plans  # noqa: F401
from corpusmetrics.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: "" if v is None else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = normal(QUERIES[name](spark, SF).toPandas()), normal(duck.sql(ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-6)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["keyword", "effort", "n", "mean_distance"]
    assert set(e.oracle_sql()) <= set(e.queries())
