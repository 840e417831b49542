"""Spectra from summed Gram matrices against the kernels over whole groups."""

import numpy as np
import pytest

from corpusmetrics.functions import kernels as K
from corpusmetrics.operators import spectra as SP


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(8)
    many = rng.normal(size=(300, 6)) * [5, 2, 1, 1, 0.5, 0.1] + 3
    return {"many": many, "few": rng.normal(size=(4, 6)), "one": rng.normal(size=(1, 6)), "same": np.ones((50, 6)), "zeros": np.zeros((20, 6)), "seven": rng.normal(size=(7, 6)), None: rng.normal(size=(40, 6))}


@pytest.fixture(scope="module")
def rows(spark, groups):
    return spark.createDataFrame([(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)], "g string, row_idx long, vec array<double>").repartition(4)


@pytest.fixture(params=[2048, 3])
def block(request, monkeypatch):
    """With blocks of three vectors and two matrices added at once, sums take many rounds."""
    monkeypatch.setattr(SP, "BLOCK", request.param)
    monkeypatch.setattr(SP, "FAN", 2 if request.param == 3 else 16)


def test_vendi(rows, groups, block):
    got = {r["g"]: (r["n"], r["vendi"]) for r in SP.vendi_scores(rows, ["g"]).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        want = K.vendi(x)
        assert got[g] == (len(x), pytest.approx(want, abs=1e-9, nan_ok=True)), g


def test_pca(rows, groups, block):
    got = SP.pca_coordinates(rows, ["g"]).collect()
    assert len(got) == sum(map(len, groups.values()))
    for g, x in groups.items():
        xy, share = K.pca_2d(x)
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["row_idx"])
        np.testing.assert_allclose([(r["x"], r["y"]) for r in own], xy, atol=1e-9)
        if np.ptp(x) > 0:
            np.testing.assert_allclose([own[0]["share_x"], own[0]["share_y"]], share, atol=1e-9)


def test_no_task_has_the_kernel(rows):
    """Of the group of 300 vectors, nothing wider than 6 x 6 numbers leaves or enters the last task."""
    sized = SP._sized(rows, ["g"], "vec").where("__n > __d")
    assert {len(r["gram"]) for r in SP.gram(sized, ["g"], "vec", "row_idx").collect()} == {6 * 6 * 8}


def test_no_rows(rows):
    assert SP.vendi_scores(rows.limit(0), ["g"]).collect() == SP.pca_coordinates(rows.limit(0), ["g"]).collect() == []
