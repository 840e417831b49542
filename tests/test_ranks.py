"""Ranks from counts, against plain sorting."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmetrics.functions import kernels as K
from corpusmetrics.operators import ranks as RK
from corpusmetrics.operators import statistics as ST


@pytest.fixture(scope="module")
def values():
    """A group of a null key, one with a value in half of its rows, one of equal rows, one of one row."""
    rng = np.random.default_rng(3)
    rows = [("many", float(v)) for v in rng.normal(size=400)] + [("half", 7.0)] * 150 + [("half", float(v)) for v in rng.integers(0, 15, 150)]
    return rows + [(None, float(v)) for v in rng.integers(-3, 3, 40)] + [("same", 1.0)] * 9 + [("one", 2.0)]


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_cumulative_counts(spark, values, ranges):
    df = spark.createDataFrame(values, "g string, v double").repartition(4)
    got = RK.cumulative(df.groupBy("g", "v").agg(F.count("*").alias("n")), ["g"], "v", ranges=ranges).collect()
    for g in {v[0] for v in values}:
        own = [v for k, v in values if k == g]
        seen = {r["v"]: (r["n"], r["below"], r["total"]) for r in got if r["g"] == g}
        assert seen == {v: (own.count(v), sum(o < v for o in own), len(own)) for v in own}


def test_average_rank_and_spearman(spark, values):
    rng = np.random.default_rng(4)
    rows = [(g, v, float(round(v) + rng.integers(3)), i) for i, (g, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double, w double, i long").repartition(4)
    ranks = {r["i"]: r["r"] for r in RK.average_rank(df, ["g"], "v", "r").collect()}
    rho = {r["g"]: r["spearman"] for r in RK.spearman(df, ["g"], "v", "w").collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        want = K.average_ranks(np.array([r[1] for r in own]))
        assert [ranks[r[3]] for r in own] == want.tolist()
        s = K.spearman(np.array([r[1] for r in own]), np.array([r[2] for r in own])) if len(own) > 1 else math.nan
        assert rho[g] == (pytest.approx(s) if not math.isnan(s) else None)


def test_places_number_rows_of_one_value(spark, values):
    rows = [(g, v, i) for i, (g, v) in enumerate(values)]
    got = RK.places(spark.createDataFrame(rows, "g string, v double, i long").repartition(4), ["g"], "v", "i").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])
        assert {r["i"]: (r["place"], r["places"]) for r in got if r["g"] == g} == {r[2]: (k, len(own)) for k, r in enumerate(own)}


def test_no_window_over_a_group(spark, values):
    """Windows are bounded by ranges: every one partitions by a range or sees one row a range."""
    df = spark.createDataFrame(values, "g string, v double")
    plan = ST.correlations(df.withColumn("w", F.col("v")), ["g"], "v", "w")._jdf.queryExecution().optimizedPlan().toString()
    for line in (x for x in plan.splitlines() if "Window [" in x):
        assert "__range" in line or "__sum" in line


def test_rank_tests_from_counts(spark, values):
    """Equal to the kernels over whole groups, small ones (exact) and all-zero ones included."""
    rng = np.random.default_rng(5)
    sets = {"ties": [0.0, 0.0, 1.0, -1.0, 2.0, 3.0, -4.0], "plain": rng.normal(size=12).tolist(), "zeros": [0.0] * 4, "long": rng.normal(0.3, 1, 80).tolist(), "worked": [0, 0, 0.3, 0.5, -0.1, 0.7, 0.9, 1.1]}
    df = spark.createDataFrame([(g, float(v), "ab"[i % 2]) for g, own in sets.items() for i, v in enumerate(own)], "g string, d double, side string").repartition(3)
    for more in ({}, {"alternative": "greater"}, {"zeros": "zsplit"}):
        got = {r["g"]: (r["w_plus"], r["p"]) for r in ST.wilcoxon_test(df, ["g"], "d", **more).collect()}
        assert got == {g: pytest.approx(K.wilcoxon_p(np.array(own, float), **more), nan_ok=True) for g, own in sets.items()}
    got = {r["g"]: (r["u"], r["p"]) for r in ST.mannwhitney_test(df, ["g"], "d", "side", "a").collect()}
    assert got == {g: pytest.approx(K.mannwhitney_p(np.array(own[::2], float), np.array(own[1::2], float))) for g, own in sets.items()}


def test_zeros_rule_the_exact_form_out():
    """Six differences beside two zeros: W+ = 20, mean 10.5, variance 22.75, so z = 9.5 / 4.7697 and p = 0.0232; without the zeros 2 of 64."""
    d = np.array([0, 0, 0.3, 0.5, -0.1, 0.7, 0.9, 1.1])
    assert K.wilcoxon_p(d, "greater") == (20.0, pytest.approx(0.0232, abs=1e-5))
    assert K.wilcoxon_p(d[2:], "greater") == (20.0, pytest.approx(2 / 64))


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double, w double, i long, side string")
    assert RK.spearman(df, ["g"], "v", "w").collect() == RK.places(df, ["g"], "v", "i").collect() == ST.wilcoxon_test(df, ["g"], "v").collect() == []
    assert isinstance(ST.mannwhitney_test(df, ["g"], "v", "side", "a").toPandas(), pd.DataFrame)
