"""Rank and paired statistics as relational expressions; p-values follow from one row of sums a group."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import guarded_corr
from . import ranks as RK


def correlations(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """n, Pearson and Spearman (mean ranks) over rows that have both values."""
    have = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    values = have.groupBy(*by).agg(F.count("*").alias("n"), guarded_corr(x, y).alias("pearson"))
    return RK.joined(values, RK.spearman(have, by, x, y), by)


def paired_effect(rows: DataFrame, by: Sequence[str], diff: str) -> DataFrame:
    """n, mean and d_z = mean / sample deviation of differences; null without deviation."""
    s = F.stddev_samp(diff)
    return rows.groupBy(*by).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean_diff"), F.when(s > 0, F.avg(diff) / F.when(s > 0, s)).alias("d_z"))


def wilcoxon_statistic(rows: DataFrame, by: Sequence[str], diff: str) -> DataFrame:
    """W+ and W- over non-zero differences with mean ranks."""
    d = rows.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("__a", F.abs(diff))
    counts = d.groupBy(*by, "__a").agg(F.count("*").alias("n"), F.count_if(F.col(diff) > 0).alias("plus"))
    r, n = RK.mean_ranks(counts, by, "__a"), F.sum("n")
    return r.groupBy(*by).agg(n.alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("plus"))).alias("w_minus"))


def mannwhitney_u(rows: DataFrame, by: Sequence[str], value: str, side: str, first: str) -> DataFrame:
    """U of the rows whose ``side`` is ``first`` against the others."""
    r, n1 = _two_samples(rows, by, value, side, first), F.sum("first")
    return r.groupBy(*by).agg(n1.alias("n_first"), F.sum(F.col("n") - F.col("first")).alias("n_other"), (F.sum(F.col("rank") * F.col("first")) - n1 * (n1 + 1) / 2).alias("u"))


def _two_samples(rows: DataFrame, by: Sequence[str], value: str, side: str, first: str) -> DataFrame:
    """by, value, n, first (rows of the first side), rank and total of each distinct value."""
    rows = rows.where(F.col(value).isNotNull() & F.col(side).isNotNull())
    return RK.mean_ranks(rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.count_if(F.col(side) == first).alias("first")), by, value)


def benjamini_hochberg(rows: DataFrame, p: str, by: Sequence[str] = (), name: str = "p_adjusted") -> DataFrame:
    """Adjusted p over all non-null p of a family; the running minimum from the largest p, at most 1."""
    own = rows.where(F.col(p).isNotNull())
    asc = Window.partitionBy(*by).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*by))
    # equal p share their largest rank
    rank = F.count("*").over(asc.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = own.withColumn("__q", F.col(p) * m / rank)
    down = Window.partitionBy(*by).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = raw.withColumn(name, F.least(F.lit(1.0), F.min("__q").over(down))).drop("__q")
    return adjusted.unionByName(rows.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def line_fit(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    v = F.var_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    return rows.groupBy(*by).agg(F.when(v > 0, F.covar_pop(x, y) / F.when(v > 0, v)).alias("slope"), F.when(v > 0, F.avg(F.when(F.col(x).isNotNull(), F.col(y))) - F.covar_pop(x, y) / F.when(v > 0, v) * F.avg(F.when(F.col(y).isNotNull(), F.col(x)))).alias("intercept"))


def _ties():
    return F.sum(F.pow("n", F.lit(3.0)) - F.col("n"))


def wilcoxon_test(rows: DataFrame, by: Sequence[str], diff: str, alternative: str = "two-sided", zeros: str = "wilcox") -> DataFrame:
    """W+ and p of each group, from counts of distinct absolute differences; NaN where all differences are zero."""
    d = rows.where(F.col(diff).isNotNull() & ~F.isnan(F.col(diff).cast("double"))).withColumn("__a", F.abs(diff))
    counts = d.groupBy(*by, "__a").agg(F.count("*").alias("n"), F.count_if(F.col(diff) > 0).alias("plus"))
    groups = counts.groupBy(*by).agg(F.sum(F.when(F.col("__a") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("__a") != 0, F.col("n")).otherwise(0)).alias("others"))
    r = RK.mean_ranks(counts if zeros == "zsplit" else counts.where("__a != 0"), by, "__a")
    plus = F.sum(F.col("rank") * F.when(F.col("__a") == 0, F.col("n") / 2.0).otherwise(F.col("plus").cast("double")))
    sums = RK.joined(groups, r.groupBy(*by).agg(plus.alias("w"), F.sum("n").alias("size"), _ties().alias("ties")), by, "left")

    @F.pandas_udf("double")
    def p(w: pd.Series, size: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
        return pd.Series([K.signed_rank_p(a, int(n), t, not t and not z, alternative) for a, n, t, z in zip(w, size, ties, zeros, strict=True)])

    some, nan = F.col("others") > 0, F.lit(float("nan"))
    out = sums.na.fill(0, ["w", "size", "ties"]).withColumn("p", p("w", "size", "ties", "zeros"))
    return out.select(*by, F.when(some, F.col("w")).otherwise(nan).alias("w_plus"), F.when(some, F.col("p")).otherwise(nan).alias("p"))


def mannwhitney_test(rows: DataFrame, by: Sequence[str], value: str, side: str, first: str) -> DataFrame:
    """U of the rows whose ``side`` is ``first`` and the two-sided p, from counts of distinct values; NaN where a side is empty."""
    r, m = _two_samples(rows, by, value, side, first), F.sum("first")
    sums = r.groupBy(*by).agg(m.alias("m"), (F.sum("n") - m).alias("others"), (F.sum(F.col("rank") * F.col("first")) - m * (m + 1) / 2).alias("u"), _ties().alias("ties"))

    @F.pandas_udf("double")
    def p(u: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([K.rank_sum_p(*x) for x in zip(u, m.astype(int), n.astype(int), ties, strict=True)])

    both = (F.col("m") > 0) & (F.col("others") > 0)
    return sums.select(*by, F.when(both, F.col("u")).otherwise(F.lit(float("nan"))).alias("u"), p("u", "m", "others", "ties").alias("p"))
