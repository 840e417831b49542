"""Tiles of vectors: how often a row travels, and that bins and counts do not depend on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmetrics.functions import vectors as V
from corpusmetrics.operators import pairs as P


@pytest.fixture(scope="module")
def samples(spark):
    x = np.random.default_rng(5).normal(size=(200, 4)).round(1)
    x[7] = 0
    rows = [("g", i, v) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "g string, row_idx long, vec array<double>").repartition(5)


def test_a_row_goes_to_sixteen_tasks_at_most(samples, monkeypatch):
    monkeypatch.setattr(P, "TILE", 4)  # fifty tiles of the least size
    tiles = P.tiled(P.unit_rows(samples, ["g"]), ["g"])
    assert tiles.count() == 200 * P.TILES and tiles.groupBy("__a", "__b").count().count() == P.TILES * (P.TILES + 1) // 2


@pytest.mark.parametrize("tile", [1024, 4])
def test_summary_and_pairs_equal_numpy(samples, monkeypatch, tile):
    monkeypatch.setattr(P, "TILE", tile)
    x = np.array([r["vec"] for r in samples.orderBy("row_idx").collect()])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    d = np.clip(1 - u @ u.T, 0, 2)[np.triu_indices(200, 1)]
    got = P.summary(samples, ["g"]).first()
    assert tuple(got)[1:] == pytest.approx((len(d), d.mean(), np.median(d), d.std()), abs=1e-9)
    hist = P.histogram(P.tiled(P.unit_rows(samples, ["g"]), ["g"]), ["g"])
    assert hist.agg(F.sum("n")).first()[0] == len(d)
    ends = samples.sparkSession.createDataFrame([("g", 0), ("g", P.BINS - 1)], "g string, bin int")
    tiles = P.tiled(P.unit_rows(samples, ["g"]), ["g"])
    found = {(r["i"], r["j"]) for r in P.in_bins(tiles, ["g"], ["g"], ends).collect()}
    at = np.minimum((np.round(d, 12) * (P.BINS / 2)).astype(int), P.BINS - 1)
    i, j = np.triu_indices(200, 1)
    pick = np.isin(at, [0, P.BINS - 1])
    assert found == set(zip(i[pick].tolist(), j[pick].tolist(), strict=True))


def test_unit_takes_the_norm_once_a_vector(spark):
    """In a large vector the norm was taken anew for every component: 20,000 of them took minutes."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double")).alias("v"))
    u = np.array(df.select(V.unit(F.col("v")).alias("u")).first()["u"])
    x = np.arange(1, 20_001.0)
    assert u == pytest.approx(x / np.linalg.norm(x), rel=1e-12)
    assert spark.sql("SELECT array(0d, 0d) AS v").select(V.unit(F.col("v"))).first()[0] == [0.0, 0.0]
    assert spark.sql("SELECT CAST(NULL AS array<double>) AS v").select(V.unit(F.col("v"))).first()[0] is None
