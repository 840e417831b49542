"""Draws of the mergeable bootstrap against plain loops over the same places."""

import math

import numpy as np
import pytest

from corpusmetrics.operators import resampling as R

MASK = 2**32 - 1


def mixed(x: int) -> int:
    x ^= x >> 16
    x = x * 2246822507 & MASK
    x ^= x >> 13
    x = x * 3266489909 & MASK
    return x ^ x >> 16


def place(n: int, draw: int, slot: int, seed: int) -> int:
    own = mixed(seed + draw * 2654435769 & MASK)
    return mixed(mixed(slot + own & MASK) + own & MASK) * n >> 32


def drawn(values: list, draws: int, seed: int = 42) -> list[list]:
    values = sorted(values)
    return [[values[place(len(values), b, k, seed)] for k in range(len(values))] for b in range(draws)]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(9)
    return {"a": rng.normal(3, 1, 40).tolist(), "b": [1.0] * 30 + [2.0] * 5, None: rng.normal(size=7).tolist(), "one": [4.0], "none": [None, math.nan]}


@pytest.fixture(scope="module")
def rows(spark, values):
    flat = [(g, v, "xy"[i % 2]) for g, own in values.items() for i, v in enumerate(own)]
    return spark.createDataFrame(flat, "g string, v double, side string").repartition(4)


def test_places_are_spread_evenly():
    """Every place is taken about equally often, and neighbouring draws and slots have nothing in common."""
    p = R.picks(50, np.arange(2000), 42).astype(int)
    assert p[7, 3] == place(50, 7, 3, 42) and p[1999, 49] == place(50, 1999, 49, 42)
    seen = np.bincount(p.ravel(), minlength=50)
    assert abs(seen - 2000).max() < 5 * math.sqrt(2000)
    assert abs(np.corrcoef(p[:-1].ravel(), p[1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(p[:, :-1].ravel(), p[:, 1:].ravel())[0, 1]) < 0.02
    shares = (np.diff(np.sort(p, axis=1), axis=1) > 0).sum(axis=1) + 1
    assert shares.mean() / 50 == pytest.approx(1 - (1 - 1 / 50) ** 50, abs=0.01)  # as many different values as draws with replacement have


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 8, "PICKS": 300, "AT_ONCE": 60}])
def test_mean(rows, values, monkeypatch, limits):
    """In one task a group, and over stretches of eight places and a few draws each: the same."""
    for k, v in limits.items():
        monkeypatch.setattr(R, k, v)
    got = {r["g"]: tuple(r)[1:] for r in R.bootstrap_mean_ci(rows, ["g"], "v", n_boot=60).collect()}
    assert got.keys() == values.keys()
    for g, own in values.items():
        own = [v for v in own if v is not None and not math.isnan(v)]
        want = (len(own), np.mean(own), *np.percentile([np.mean(d) for d in drawn(own, 60)], [2.5, 97.5])) if own else (0, math.nan, math.nan, math.nan)
        assert got[g] == pytest.approx(want, nan_ok=True), g


def test_ratio(rows, values):
    got = {r["g"]: tuple(r)[1:] for r in R.bootstrap_ratio_ci(rows, ["g"], "v", "side", "x", "y", n_boot=50).collect()}
    for g in ("a", "b", None):
        x, y = values[g][::2], values[g][1::2]
        means = zip(drawn(x, 50), drawn(y, 50, 43), strict=True)
        assert got[g] == pytest.approx((np.mean(x) / np.mean(y), *np.percentile([np.mean(p) / np.mean(q) for p, q in means], [2.5, 97.5])))
    assert all(map(math.isnan, got["one"])) and all(map(math.isnan, got["none"]))


@pytest.mark.parametrize("chunk", [1 << 18, 5])
def test_pearson(spark, monkeypatch, chunk):
    """Few rows make draws without variance: left out where guarded, else the interval is NaN."""
    monkeypatch.setattr(R, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    sets = {"wide": [(float(a), float(a + rng.normal())) for a in rng.normal(size=30)], "steps": [(float(a), float(b)) for a, b in rng.integers(0, 3, (25, 2))], "three": [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)], "two": [(1.0, 2.0), (2.0, 3.0)], "flat": [(1.0, float(k)) for k in range(5)]}
    df = spark.createDataFrame([(g, *p) for g, own in sets.items() for p in own] + [("wide", None, 1.0)], "g string, x double, y double").repartition(3)
    got = {r["g"]: tuple(r)[1:] for r in R.bootstrap_pearson_ci(df, ["g"], "x", "y", n_boot=80).collect()}
    for g in ("wide", "steps", "three"):
        x, y = np.array(sets[g]).T
        rs = [np.corrcoef(*np.array(d).T)[0, 1] for d in drawn(sets[g], 80) if np.ptp(np.array(d)[:, 0]) > 0 and np.ptp(np.array(d)[:, 1]) > 0]
        assert got[g] == pytest.approx((len(x), np.corrcoef(x, y)[0, 1], *np.percentile(rs, [2.5, 97.5]))), g
    assert got["two"][0] == 2 and all(map(math.isnan, got["two"][1:])) and math.isnan(got["flat"][1])
    loose = {r["g"]: tuple(r)[1:] for r in R.bootstrap_pearson_ci(df, ["g"], "x", "y", n_boot=80, guarded=False).collect()}
    assert loose["wide"] == pytest.approx(got["wide"]) and loose["two"][1] == pytest.approx(1.0) and all(map(math.isnan, loose["three"][2:]))


def test_no_rows(rows):
    assert R.bootstrap_mean_ci(rows.limit(0), ["g"], "v").collect() == R.bootstrap_ratio_ci(rows.limit(0), ["g"], "v", "side", "x", "y").collect() == []
