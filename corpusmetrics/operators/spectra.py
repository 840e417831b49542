"""Vendi scores and principal axes from the spectrum of one small matrix a group.

The kernel of n vectors of d components and its d x d Gram matrix have the same eigenvalues but for zeros.  A group
of more than d vectors is summed to that matrix: blocks of vectors give partial Gram matrices, and these meet
FAN at a time until one is left.  A group of at most d vectors is small itself and goes to one task.
So no task holds more than d x d numbers a matrix, however many vectors a group has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import vectors as V
from . import ranks as RK
from .pairs import kinds

#: Vectors of a block, and partial matrices that are added at once.
BLOCK, FAN = 2048, 16


def _sized(samples: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """The rows with __n, the vectors of their group, and __d, their components."""
    rows = samples.withColumn(vec, V.doubles(F.col(vec)))
    return RK.joined(rows, rows.groupBy(*by).agg(F.count("*").alias("__n"), F.max(F.size(vec)).alias("__d")), by)


def _keyed(pdf: pd.DataFrame, by: Sequence[str], **values) -> pd.DataFrame:
    return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, **{k: [v] for k, v in values.items()}})


def gram(rows: DataFrame, by: Sequence[str], vec: str, index: str) -> DataFrame:
    """by, n, d and the Gram matrix (bytes of doubles) of the vectors of each group.  ``rows``: with __n of _sized."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vec].to_numpy())
        return _keyed(pdf, [*by, "__part"], __parts=pdf["__parts"].iloc[0], n=len(x), d=x.shape[1], gram=(x.T @ x).tobytes())

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(int(pdf["d"].iloc[0]) ** 2)
        for one in pdf["gram"]:
            total += np.frombuffer(one)
        return _keyed(pdf, [*by, "__part"], __parts=pdf["__parts"].iloc[0], n=int(pdf["n"].sum()), d=int(pdf["d"].iloc[0]), gram=total.tobytes())

    kind = kinds(rows, by) + "__part long, __parts long, n long, d long, gram binary"
    parts = F.ceil(F.col("__n") / BLOCK).cast("long")
    rows = rows.withColumn("__parts", parts).withColumn("__part", F.pmod(F.xxhash64(index), F.col("__parts")))
    most = rows.agg(F.max("__parts")).first()[0] or 1
    out = rows.select(*by, "__part", "__parts", vec).groupBy(*by, "__part").applyInPandas(block, kind)
    while most > 1:
        most = -(-most // FAN)
        out = out.withColumn("__part", F.floor(F.col("__part") / FAN)).groupBy(*by, "__part").applyInPandas(added, kind)
    return out.select(*by, "n", "d", "gram")


def _matrix(row: pd.Series) -> np.ndarray:
    d = int(row["d"])
    return np.frombuffer(row["gram"]).reshape(d, d)


def vendi_scores(samples: DataFrame, by: Sequence[str], vec: str = "vec", index: str = "row_idx") -> DataFrame:
    """by, n and exp of the entropy of the eigenvalues of the cosine kernel over n."""
    rows = _sized(samples.select(*by, index, vec), by, vec)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return _keyed(pdf, by, n=len(pdf), vendi=K.vendi(np.stack(pdf[vec].to_numpy())))

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        return _keyed(pdf, by, n=row["n"], vendi=K.spectral_entropy(np.linalg.eigvalsh(_matrix(row) / row["n"])))

    kind = kinds(rows, by) + "n long, vendi double"
    small = rows.where("__n <= __d").groupBy(*by).applyInPandas(whole, kind)
    large = rows.where("__n > __d").withColumn(vec, V.unit(F.col(vec)))
    return small.unionByName(gram(large, by, vec, index).groupBy(*by).applyInPandas(spectrum, kind))


def pca_coordinates(samples: DataFrame, by: Sequence[str], index: str = "row_idx", vec: str = "vec") -> DataFrame:
    """x, y of each row by the principal axes of its panel, and the panel's shares of variance."""
    rows = _sized(samples.select(*by, index, vec), by, vec)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        xy, share = K.pca_2d(np.stack(pdf[vec].to_numpy()))
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in by}, index: pdf[index].to_numpy(), "x": xy[:, 0], "y": xy[:, 1], "share_x": share[0], "share_y": share[1]})

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        found, share = K.principal_axes(_matrix(pdf.iloc[0]))
        return _keyed(pdf, by, first=found[0].tolist(), second=found[1].tolist(), share_x=share[0], share_y=share[1])

    kind = kinds(rows, by) + f"`{index}` {dict(rows.dtypes)[index]}, x double, y double, share_x double, share_y double"
    small = rows.where("__n <= __d").select(*by, index, vec).groupBy(*by).applyInPandas(whole, kind)
    large = rows.where("__n > __d")
    centred = RK.joined(large, large.groupBy(*by).agg(V.vector_mean(F.col(vec)).alias("__mean")), by).withColumn(vec, F.zip_with(vec, "__mean", lambda x, m: x - m)).drop("__mean")
    found = gram(centred, by, vec, index).groupBy(*by).applyInPandas(axes, kinds(rows, by) + "first array<double>, second array<double>, share_x double, share_y double")
    placed = RK.joined(centred, found, by).select(*by, index, V.dot(F.col(vec), F.col("first")).alias("x"), V.dot(F.col(vec), F.col("second")).alias("y"), "share_x", "share_y")
    return small.unionByName(placed)
