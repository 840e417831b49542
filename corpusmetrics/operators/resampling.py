"""Bootstrap intervals and permutation tests by group.

A bootstrap needs no group in one task: values have places by their order, the place that a slot of a
draw takes is a hash of seed, draw and slot, and tasks sum stretches of places.  So results
depend on the values alone, not on how rows are partitioned, and sums merge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import guarded_corr
from . import ranks as RK


def _kinds(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by)


#: Picks that a task makes about, picks worked on at once, and distinct values of a task.
PICKS, AT_ONCE, CHUNK = 50_000_000, 2_000_000, 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a common 32-bit hash."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(2246822507)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(3266489909)
    return x ^ (x >> np.uint32(16))


def picks(n: int, draws: np.ndarray, seed: int) -> np.ndarray:
    """The places, 0 to n - 1, that each draw takes for its n slots: a counter-based hash of seed, draw and slot."""
    with np.errstate(over="ignore"):
        own = _mixed(np.uint32(seed) + draws.astype(np.uint32) * np.uint32(2654435769))[:, None]
        x = _mixed(_mixed(np.arange(n, dtype=np.uint32)[None, :] + own) + own)
    return (x.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)


def _drawn(placed: DataFrame, by: Sequence[str], sums: dict[str, Callable], n_boot: int, seed: int) -> DataFrame:
    """by, draw and the sums over what each draw takes.

    ``placed``: distinct values with n, below and total, as ``ranks.cumulative`` gives them: a value has the places from
    below to below + n - 1.  A task has a stretch of places and some draws, and sums what falls into its stretch.
    """
    tasks = F.greatest(F.lit(1), F.least(F.lit(n_boot), F.ceil(F.col("total") * n_boot / PICKS))).cast("int")
    dealt = placed.withColumn("__chunk", F.floor(F.col("below") / CHUNK)).withColumn("__tasks", tasks).withColumn("__task", F.explode(F.sequence(F.lit(0), F.col("__tasks") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("below", ignore_index=True)
        below, total = pdf["below"].to_numpy(), int(pdf["total"].iloc[0])
        end = int(below[-1]) + int(pdf["n"].iloc[-1])
        whole = below[0] == 0 and end == total
        columns = {name: f(pdf).to_numpy(float) for name, f in sums.items()}
        draws = np.arange(int(pdf["__task"].iloc[0]), n_boot, int(pdf["__tasks"].iloc[0]))
        out = {name: np.zeros(len(draws)) for name in sums}
        step = max(1, AT_ONCE // total)
        for i in range(0, len(draws), step):
            place = picks(total, draws[i : i + step], seed).astype(np.int64)
            here = None if whole else (place >= below[0]) & (place < end)
            at = np.searchsorted(below, place if whole else np.clip(place, below[0], end - 1), "right") - 1
            for name, v in columns.items():
                out[name][i : i + step] = (v[at] if whole else np.where(here, v[at], 0.0)).sum(axis=1)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(draws) for c in by}, "draw": draws, **out})

    kinds = _kinds(placed, by) + ", draw long, " + ", ".join(f"{c} double" for c in sums)
    return dealt.groupBy(*by, "__chunk", "__task").applyInPandas(run, kinds).groupBy(*by, "draw").agg(*(F.sum(c).alias(c) for c in sums))


def _ends(by: Sequence[str], stats: DataFrame, stat: str) -> DataFrame:
    """by, ci_low, ci_high: percentiles 2.5 and 97.5 over the draws that have the statistic."""
    return stats.groupBy(*by).agg(*(F.percentile(stat, F.lit(q)).alias(c) for q, c in ((0.025, "ci_low"), (0.975, "ci_high"))))


def _real(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all these values, as doubles."""
    rows = rows.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns})
    return rows.dropna(subset=list(columns))


def _nan(c: str) -> F.Column:
    return F.coalesce(c, F.lit(float("nan"))).alias(c)


def _placed(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return RK.cumulative(rows.groupBy(*by, value).agg(F.count("*").alias("n")), by, value)


def bootstrap_mean_ci(rows: DataFrame, by: Sequence[str], value: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """by, n, mean and its percentile interval over draws with replacement; NaN without values."""
    own = _real(rows, value)
    means = _drawn(_placed(own, by, value), by, {"sum": lambda pdf: pdf[value]}, n_boot, seed)
    sizes = own.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    ends = RK.joined(sizes, _ends(by, means, "sum"), by)  # percentiles of sums, over n below, are those of means
    out = RK.joined(rows.select(*by).distinct(), ends, by, "left")
    ends = [(F.col(c) / F.col("n")).alias(c) for c in ("ci_low", "ci_high")]
    out = out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), "mean", *ends)
    return out.select(*by, "n", _nan("mean"), _nan("ci_low"), _nan("ci_high"))


def bootstrap_ratio_ci(rows: DataFrame, by: Sequence[str], value: str, side: str, num: str, den: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """by, ratio of the means of two sides and its interval; sides are drawn on their own, draws whose denominator is near zero are left out."""
    own = _real(rows, value)
    parts = []
    for k, s in enumerate((num, den)):
        of = own.where(F.col(side) == s)
        sums = _drawn(_placed(of, by, value), by, {f"s{k}": lambda pdf: pdf[value]}, n_boot, seed + k)
        parts.append(RK.joined(sums, of.groupBy(*by).agg(F.count("*").alias(f"n{k}"), F.avg(value).alias(f"m{k}")), by).withColumn(f"s{k}", F.col(f"s{k}") / F.col(f"n{k}")))
    both = RK.joined(parts[0], parts[1], [*by, "draw"])
    ratio = lambda a, b: F.when(F.abs(b) >= 1e-9, F.col(a) / F.when(F.abs(b) >= 1e-9, F.col(b)))
    ends = [F.percentile(ratio("s0", "s1"), F.lit(q)).alias(c) for q, c in ((0.025, "ci_low"), (0.975, "ci_high"))]
    found = both.groupBy(*by).agg(F.first(ratio("m0", "m1")).alias("ratio"), *ends)
    out = RK.joined(rows.select(*by).distinct(), found, by, "left")
    return out.select(*by, _nan("ratio"), _nan("ci_low"), _nan("ci_high"))


def bootstrap_pearson_ci(rows: DataFrame, by: Sequence[str], x: str, y: str, n_boot: int = 1000, seed: int = 42, guarded: bool = True) -> DataFrame:
    """by, n, r and its interval over draws of pairs.

    guarded: draws without variance are left out, and NaN below three pairs; else such draws make the interval NaN, as a plain loop would.
    """
    own = _real(rows, x, y)
    centre = own.groupBy(*by).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.var_pop(x).alias("__vx"), F.var_pop(y).alias("__vy"), F.count("*").alias("n"), guarded_corr(x, y).alias("r"))
    rows_of = own.groupBy(*by, x, y).agg(F.count("*").alias("n"))
    first = RK.cumulative(rows_of.groupBy(*by, x).agg(F.sum("n").alias("n")), by, x).select(*by, x, F.col("below").alias("__first"), F.col("total").alias("__all"))
    placed = RK.joined(RK.cumulative(rows_of, [*by, x], y), first, [*by, x])
    placed = placed.withColumn("below", F.col("below") + F.col("__first")).withColumn("total", F.col("__all")).drop("__first", "__all")
    placed = RK.joined(placed, centre.drop("n", "r", "__vx", "__vy"), by).withColumn(x, F.col(x) - F.col("__mx")).withColumn(y, F.col(y) - F.col("__my"))
    sums = {"sx": lambda p: p[x], "sy": lambda p: p[y], "sxx": lambda p: p[x] ** 2, "syy": lambda p: p[y] ** 2, "sxy": lambda p: p[x] * p[y]}
    drawn = RK.joined(_drawn(placed, by, sums, n_boot, seed), centre, by)
    n = F.col("n")
    vx, vy = (F.col(f"s{v}{v}") / n - F.pow(F.col(f"s{v}") / n, F.lit(2.0)) for v in "xy")
    varied = (vx > 1e-12 * F.col("__vx")) & (vy > 1e-12 * F.col("__vy"))
    r = F.when(varied, (F.col("sxy") / n - F.col("sx") * F.col("sy") / (n * n)) / F.sqrt(F.when(varied, vx * vy)))
    drawn = drawn.select(*by, F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("b"))
    ends = _ends(by, drawn, "b")
    if not guarded:
        flat = drawn.groupBy(*by).agg((F.count("*") > F.count("b")).alias("flat"))
        ends = RK.joined(ends, flat, by).select(*by, *(F.when(~F.col("flat"), F.col(c)).alias(c) for c in ("ci_low", "ci_high")))
    out = RK.joined(RK.joined(rows.select(*by).distinct(), centre.select(*by, "n", "r"), by, "left"), ends, by, "left")
    out = out.withColumn("n", F.coalesce("n", F.lit(0)))
    keep = lambda c: F.when((F.col("n") >= 3) | F.lit(not guarded), F.col(c)).alias(c)
    return out.select(*by, "n", *map(keep, ("r", "ci_low", "ci_high"))).select(*by, "n", *map(_nan, ("r", "ci_low", "ci_high")))


def _pairs(kernel, names: tuple[str, ...]):
    def op(rows: DataFrame, by: Sequence[str], x: str, y: str, seed: int = 42) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[[x, y]].dropna().sort_values([x, y]).to_numpy(float)
            out = kernel(own[:, 0], own[:, 1], K.seed_of(*(pdf[c].iloc[0] for c in by), base=seed))
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "n": [len(own)], **{k: [v] for k, v in zip(names, out, strict=True)}})

        return rows.select(*by, x, y).groupBy(*by).applyInPandas(run, _kinds(rows, by) + ", n long, " + ", ".join(f"{c} double" for c in names))

    return op


perm_spearman = _pairs(K.perm_spearman, ("rho", "p"))
