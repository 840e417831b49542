"""Strata, skipped contrasts, ties of neighbours and of extreme pairs: small cases worked by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmetrics.operators import contrasts as X
from corpusmetrics.operators import pairs as P
from corpusmetrics.operators import selection as S


@pytest.fixture(scope="module")
def cells(spark):
    """Eleven keywords with base values 0 to 10 (quarters of two), one without a value, and a second cell that k0 lacks."""
    rows = [(f"k{i}", "default", "low", float(i)) for i in range(11)] + [("none", "default", "low", None)] + [(f"k{i}", "vs", "low", float(2 * i)) for i in range(1, 11)]
    return spark.createDataFrame(rows, "keyword string, kind string, effort string, value double")


def strata(df):
    return {r["keyword"]: r["stratum"] for r in df.collect()}


def test_quarters_and_draws(cells):
    assert strata(X.quartile_strata(cells)) == {"k0": "Q1", "k1": "Q1", "k9": "Q4", "k10": "Q4"}
    drawn = strata(X.quartile_strata(cells, per_stratum=1))
    assert sorted(drawn.values()) == ["Q1", "Q4"] and drawn.items() <= strata(X.quartile_strata(cells)).items()
    assert strata(X.quartile_strata(cells.repartition(7), per_stratum=1)) == drawn
    assert strata(X.quartile_strata(cells, per_stratum=5, short="all")) == strata(X.quartile_strata(cells))
    with pytest.raises(Exception, match="fewer than 5"):
        X.quartile_strata(cells, per_stratum=5).collect()


def test_exclusions_follow_the_draw(cells):
    """An excluded keyword leaves a gap; nobody takes its place."""
    drawn = strata(X.quartile_strata(cells, per_stratum=2))
    assert strata(X.quartile_strata(cells, per_stratum=2, excluded=["k9"])) == {k: v for k, v in drawn.items() if k != "k9"}


def test_missing_cells_are_skipped_rows(cells):
    """k0 has no second cell: it is left out, the contrast stays; no keyword has the third cell: a row that says so."""
    contrasts = [("vs", "low", "default", "low"), ("ssot", "low", "default", "low")]
    table = X.gain_means(X.gains(cells, X.quartile_strata(cells), contrasts))
    got = {r["contrast"]: (r["skipped"], r["n_q1"], r["n_q4"], r["abs_gain_q4"]) for r in X.with_skipped(table, cells, contrasts).collect()}
    assert got == {"vs-low vs default-low": (None, 1, 2, 9.5), "ssot-low vs default-low": ("missing cell", None, None, None)}


def test_sizes_of_strata_count_all_keywords(spark, cells):
    rows = spark.createDataFrame([("c", "k1", 0.5), ("c", "k9", 0.25)], "contrast string, keyword string, m double")
    got = {r["stratum"]: (r["n"], r["m"]) for r in X.separation_means(rows, X.quartile_strata(cells), ["m"]).collect()}
    assert got == {"Q1": (2, 0.5), "Q4": (2, 0.25)}


def test_labels_that_are_numbers_break_ties_as_numbers(spark):
    """Four equal vectors with labels 5, 10, 9 and 2: the neighbour of the first is label 2, and that of label 2 is 5."""
    rows = spark.createDataFrame([(0, "p", 5, [1.0, 0.0]), (1, "p", 10, [1.0, 0.0]), (2, "p", 9, [1.0, 0.0]), (3, "p", 2, [1.0, 0.0])], "row_idx long, panel string, label int, vec array<double>")
    near = {r["i"]: r["label_j"] for r in P.nearest(rows, ["panel"], "label", 1).collect()}
    assert near == {0: 2, 1: 2, 2: 2, 3: 5}


def test_ties_send_few_pairs(spark):
    """Of 120 vectors 60 are equal: at most 2 m pairs leave two tiles, and the chosen ones are those of the lowest ids."""
    rng = np.random.default_rng(2)
    rows = [(i, "g", [1.0, 0.0, 0.0] if i % 2 else rng.normal(size=3).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "row_idx long, g string, vec array<double>")
    tiles = P.tiled(P.unit_rows(df, ["g"]), ["g"])
    assert P.extremes(tiles, ["g"], 5).count() <= 10
    pairs = S.stratified_pairs(df, ["g"], 5)
    nearest = sorted((r["rank"], r["i"], r["j"]) for r in pairs.where(F.col("stratum") == "bottom").collect())
    assert nearest == [(k + 1, 1, 2 * k + 3) for k in range(5)]
