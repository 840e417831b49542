"""Distances of all pairs of a group without a row for each pair.

The rows of a group are dealt to tiles of about TILE vectors, and tiles meet in tasks that take
one matrix product.  What leaves a task is a histogram, or the few pairs that are wanted:
medians and ranks are exact, because the bins that hold them are named by a first pass over
the histograms and only their distances are sent by a second one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Vectors of a tile, and bins of the range of distances, 0 to 2.
TILE, BINS = 1024, 1 << 14
#: Tiles of a group, unless a tile gets more rows than MOST.
TILES, MOST = 16, 1 << 16


def kinds(df: DataFrame, cols: Sequence[str]) -> str:
    return "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in cols)


def tiles(n: Column, least: int, most: int = TILES) -> Column:
    """Tiles of a group of n rows: up to ``most`` of ``least`` rows or more, so that what travels grows like n; more only beyond MOST rows a tile."""
    return F.greatest(F.least(F.lit(most), F.ceil(n / least)), F.ceil(n / MOST)).cast("long")


def meeting(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """``rows`` with their tile __own of __tiles, for every task they go to: the tiles __a, __b, and __side (0: of __a, 1: of __b only)."""
    place = "named_struct('a', {}, 'b', {}, 'side', {})"
    if ordered:
        to = f"concat(transform(sequence(0L, __tiles - 1), t -> {place.format('__own', 't', '0')}), transform(sequence(0L, __tiles - 1), t -> {place.format('t', '__own', '1')}))"
    else:
        to = f"transform(sequence(0L, __tiles - 1), t -> {place.format('least(__own, t)', 'greatest(__own, t)', 'if(__own <= t, 0, 1)')})"
    rows = rows.withColumn("__p", F.explode(F.expr(to)))
    return rows.select("*", F.col("__p.a").alias("__a"), F.col("__p.b").alias("__b"), F.col("__p.side").alias("__side")).drop("__p", "__tiles", "__own")


def apart(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dealt by ``keys`` to as many tasks as a shuffle has: few bytes here stand for many pairs, so small partitions must not be put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tiled(rows: DataFrame, by: Sequence[str], ordered: bool = False, most: int = TILES) -> DataFrame:
    """``rows`` (by, i, u and others) with the tiles __a, __b of every task they go to, and __side (0: of __a, 1: of __b only).

    ordered: every tile meets every tile, as __a and as __b; else every two tiles meet once.
    """
    sizes = rows.groupBy(*by).agg(tiles(F.count("*"), TILE, most).alias("__tiles"))
    rows = rows.join(sizes, list(by)).withColumn("__own", F.pmod(F.xxhash64("i"), F.col("__tiles")))
    return meeting(rows, ordered)


def cosine(first: pd.DataFrame, second: pd.DataFrame) -> np.ndarray:
    x = np.stack(first["u"].to_numpy())
    y = x if second is first else np.stack(second["u"].to_numpy())
    return np.clip(1 - x @ y.T, 0.0, 2.0)


def parts(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The rows of the two tiles of a task by at most TILE, all that meet; of a tile that meets itself every two once, and a part with itself as the same frame."""
    first, second = pdf[pdf["__side"] == 0], pdf[pdf["__side"] == 1]
    same = not len(second) and pdf["__a"].iloc[0] == pdf["__b"].iloc[0]
    for lo in range(0, len(first), TILE):
        one = first.iloc[lo : lo + TILE]
        if same:
            yield one, one
        for at in range(lo + TILE if same else 0, len(first if same else second), TILE):
            yield one, (first if same else second).iloc[at : at + TILE]


def products(tiles: DataFrame, by: Sequence[str], found: Callable[..., pd.DataFrame], kind: str, measure: Callable = cosine, merged: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """``found(first, second, distances)`` for all parts of every two tiles that meet, ``merged`` over those of a task, with the keys of their group in front.

    first and second are rows of either tile; for a part that meets itself they are the same.
    """
    head = [c for c in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # rounded: the last bits depend on how many rows a product has
        out = [found(first, second, np.round(measure(first, second), 12)) for first, second in parts(pdf)]
        out = [o for o in out if len(o)]
        if not out:
            return pd.DataFrame()
        out = out[0] if len(out) == 1 else pd.concat(out, ignore_index=True) if merged is None else merged(pd.concat(out, ignore_index=True))
        for k, c in enumerate(head):
            out.insert(k, c, [pdf[c].iloc[0]] * len(out))
        return out

    return apart(tiles, [*by, "__a", "__b"]).groupBy(*by, "__a", "__b").applyInPandas(run, kinds(tiles, by) + kind)


def unit_rows(samples: DataFrame, by: Sequence[str], index: str = "row_idx", more: Sequence = ()) -> DataFrame:
    return samples.select(*by, F.col(index).alias("i"), V.unit(V.doubles(F.col("vec"))).alias("u"), *more)


def pairs_of(first: pd.DataFrame, second: pd.DataFrame, d: np.ndarray):
    """Rows and columns of the pairs of two tiles, each pair once."""
    return np.triu_indices(len(first), 1) if first is second else tuple(x.ravel() for x in np.indices(d.shape))


def values_of(first: pd.DataFrame, second: pd.DataFrame, d: np.ndarray) -> np.ndarray:
    """The distances of these pairs, in the same order."""
    return d[pairs_of(first, second, d)] if first is second else d.ravel()


def _bin(d: np.ndarray) -> np.ndarray:
    return np.minimum((d * (BINS / 2)).astype(np.int64), BINS - 1)


def histogram(tiles: DataFrame, by: Sequence[str], measure: Callable = cosine) -> DataFrame:
    """by, bin, n and the sums of d - 1 and (d - 1)**2 of the pairs in it, by task."""

    def found(first, second, d):
        d = values_of(first, second, d)
        at = _bin(d)
        d -= 1
        sums = [np.bincount(at, minlength=BINS), np.bincount(at, d, BINS), np.bincount(at, np.square(d, out=d), BINS)]
        at = np.flatnonzero(sums[0])
        return pd.DataFrame({"bin": at, **{c: x[at] for c, x in zip("nsq", sums, strict=True)}})

    def merged(pdf):
        return pdf.groupby("bin", as_index=False).sum()

    return products(tiles, by, found, "bin long, n long, s double, q double", measure, merged)


def between_ranks(hist: DataFrame, by: Sequence[str], first, last) -> DataFrame:
    """The bins of a group that hold its pairs of ascending rank ``first`` to ``last`` (from 1; in terms of __size): by, bin, __below (pairs in lower bins), __size."""
    h = hist.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by).orderBy("bin")  # a row for each bin at most
    h = h.withColumn("__upto", F.sum("n").over(w)).withColumn("__size", F.sum("n").over(Window.partitionBy(*by)))
    h = h.withColumn("__below", F.col("__upto") - F.col("n"))
    return h.where((F.col("__upto") >= first) & (F.col("__below") < last)).select(*by, "bin", "__below", "__size")


def in_bins(tiles: DataFrame, by: Sequence[str], group: Sequence[str], wanted: DataFrame, measure: Callable = cosine) -> DataFrame:
    """by, i, j, distance, bin of the pairs in the bins that ``wanted`` names for their ``group``."""
    named = wanted.groupBy(*group).agg(F.sort_array(F.collect_set("bin")).alias("__bins"))

    def found(first, second, d):
        bins = np.asarray(first["__bins"].iloc[0], np.int64)
        # bins end at multiples of 2 / BINS, which are exact: only what may lie in one is looked at
        r, c = np.nonzero((d >= bins.min() * (2 / BINS)) & ((d < (bins.max() + 1) * (2 / BINS)) | (bins.max() == BINS - 1)))
        if first is second:
            r, c = r[r < c], c[r < c]
        d = d[r, c]
        pick = np.isin(_bin(d), bins)
        a, b = first["i"].to_numpy()[r[pick]], second["i"].to_numpy()[c[pick]]
        return pd.DataFrame({"i": np.minimum(a, b), "j": np.maximum(a, b), "distance": d[pick], "bin": _bin(d[pick])})

    return products(tiles.join(named, list(group)), by, found, "i long, j long, distance double, bin long", measure)


def summary(samples: DataFrame, by: Sequence[str], group: Sequence[str] | None = None, index: str = "row_idx") -> DataFrame:
    """n_pairs, mean, median and population deviation of the distances of the pairs within ``by``, by ``group`` (some of ``by``)."""
    return summary_of(tiled(unit_rows(samples, by, index), by), by, by if group is None else group)


def summary_of(tiles: DataFrame, by: Sequence[str], group: Sequence[str], measure: Callable = cosine) -> DataFrame:
    group = list(group)
    hist = histogram(tiles, by, measure)
    n = F.sum("n")
    mean = F.sum("s") / n
    sums = hist.groupBy(*group).agg(n.alias("n_pairs"), (1 + mean).alias("mean_distance"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / n - mean * mean)).alias("std_distance"))
    lower, upper = F.floor((F.col("__size") + 1) / 2), F.floor(F.col("__size") / 2) + 1
    wanted = between_ranks(hist, group, lower, upper)
    d = in_bins(tiles, by, group, wanted, measure).join(wanted, [*group, "bin"])
    rank = F.row_number().over(Window.partitionBy(*group, "bin").orderBy("distance")) + F.col("__below")
    median = d.withColumn("__r", rank).where((F.col("__r") >= lower) & (F.col("__r") <= upper)).groupBy(*group).agg(F.avg("distance").alias("median_distance"))
    return sums.join(median, group).select(*group, "n_pairs", "mean_distance", "median_distance", "std_distance")


def all_pairs(samples: DataFrame, by: Sequence[str], index: str = "row_idx") -> DataFrame:
    return allpairs_of(tiled(unit_rows(samples, by, index), by), by)


def allpairs_of(tiles: DataFrame, by: Sequence[str], measure: Callable = cosine) -> DataFrame:
    """by, i, j, distance of every pair i < j: for those who need all of them."""

    def found(first, second, d):
        r, c = pairs_of(first, second, d)
        a, b = first["i"].to_numpy()[r], second["i"].to_numpy()[c]
        return pd.DataFrame({"i": np.minimum(a, b), "j": np.maximum(a, b), "distance": d[r, c]})

    return products(tiles, by, found, "i long, j long, distance double", measure)


def _least(d: np.ndarray, i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Places of the m least of d, ties by i, then j."""
    upto = np.flatnonzero(d <= np.partition(d, m - 1)[m - 1])
    return upto[np.lexsort((j[upto], i[upto], d[upto]))[:m]]


def extremes(tiles: DataFrame, by: Sequence[str], m: int) -> DataFrame:
    """by, i, j, distance of the m nearest and m farthest pairs of every two tiles, of ties those of the least i, then j: 2 m rows at most."""

    def found(first, second, d):
        r, c = pairs_of(first, second, d)
        d = d[r, c]
        a, b = first["i"].to_numpy()[r], second["i"].to_numpy()[c]
        i, j = np.minimum(a, b), np.maximum(a, b)
        if len(d) > 2 * m:
            own = [_least(sign * d, i, j, m) for sign in (1, -1)]
            pick = np.unique(np.concatenate(own))
            i, j, d = i[pick], j[pick], d[pick]
        return pd.DataFrame({"i": i, "j": j, "distance": d})

    return products(tiles, by, found, "i long, j long, distance double")


def nearest(samples: DataFrame, panel: Sequence[str], label: str, k: int, index: str = "row_idx") -> DataFrame:
    """panel, i, label_i, j, label_j, distance, rank of the k nearest others of each row; ties go to the lower label, then the lower index."""
    rows = unit_rows(samples, panel, index, [F.col(label).alias("label")])

    def found(first, second, d):
        i, j = first["i"].to_numpy(), second["i"].to_numpy()
        own, other = first["label"].to_numpy(), second["label"].to_numpy()
        place = np.empty(len(j), np.int64)  # order among equal distances
        place[np.lexsort((j, pd.factorize(other, sort=True)[0]))] = np.arange(len(j))  # labels in their own order
        d[i[:, None] == j[None, :]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(j) > k else np.full(len(i), 2.0)
        r, c = np.nonzero((d <= last[:, None]) & np.isfinite(d))
        by = np.lexsort((place[c], d[r, c], r))
        r, c = r[by], c[by]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[keep], c[keep]
        return pd.DataFrame({"i": i[r], "label_i": own[r], "j": j[c], "label_j": other[c], "distance": d[r, c]})

    kind = dict(rows.dtypes)["label"]
    near = products(tiled(rows, panel, ordered=True), panel, found, f"i long, label_i {kind}, j long, label_j {kind}, distance double")
    w = Window.partitionBy(*panel, "i").orderBy("distance", "label_j", "j")  # k rows for each tile of the panel
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
