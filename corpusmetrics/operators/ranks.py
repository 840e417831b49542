"""Ranks of values within groups from counts of distinct values, and places of rows, without a window over a whole group.

The range of values is cut at points that one pass estimates; a window covers the distinct values of
a group within one range, and sums over ranges do the rest.  Equal values, however many rows
hold them, are one row from the first, partial aggregation on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt to; windows hold about one part in so many of a group's distinct values.
RANGES = 256


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are keys too."""
    right = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (left[k].eqNullSafe(right[f"__of_{k}"]) for k in keys), F.lit(True))
    return left.join(right, on, how).drop(*(f"__of_{k}" for k in keys))


def cumulative(counts: DataFrame, by: Sequence[str], value: str, n: str = "n", ranges: int = RANGES) -> DataFrame:
    """``counts`` (by, value, n; one row a distinct value) with below, the rows of lower values of the group, and total."""
    points = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    cuts = counts.agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), points, F.lit(10 * ranges))).alias("__cuts"))  # one row
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col(value).cast("double")))).drop("__cuts")
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    sums = dealt.groupBy(*by, "__range").agg(F.sum(n).alias("__sum"))  # at most ``ranges`` rows a group
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).withColumn("total", F.sum("__sum").over(Window.partitionBy(*by))).drop("__sum")
    out = joined(dealt, sums, [*by, "__range"])
    return out.withColumn("below", F.col("__inside") + F.col("__before")).drop("__range", "__inside", "__before")


def mean_ranks(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` with rank (from 1, rows of one value sharing their mean) and total."""
    return cumulative(counts, by, value, n).withColumn("rank", F.col("below") + (F.col(n) + 1) / 2.0).drop("below")


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """The rows with their rank from 1, ties sharing their mean."""
    ranks = mean_ranks(df.groupBy(*by, value).agg(F.count("*").alias("n")), by, value).select(*by, value, F.col("rank").alias(name))
    return joined(df, ranks, [*by, value])


def rank_pairs(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, x, y, n (rows with this pair of values), __rank_x and __rank_y: their mean ranks about the mean of all ranks."""
    pairs = rows.groupBy(*by, x, y).agg(F.count("*").alias("n"))
    for v, name in ((x, "__rank_x"), (y, "__rank_y")):
        ranks = mean_ranks(pairs.groupBy(*by, v).agg(F.sum("n").alias("n")), by, v)
        pairs = joined(pairs, ranks.select(*by, v, (F.col("rank") - (F.col("total") + 1) / 2.0).alias(name)), [*by, v])
    return pairs


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """by, Spearman's rho (mean ranks); null for fewer than two rows or a constant column."""
    s = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    scale = F.sqrt(s("__rank_x", "__rank_x")) * F.sqrt(s("__rank_y", "__rank_y"))
    return rank_pairs(rows, by, x, y).groupBy(*by).agg(F.when(scale > 0, s("__rank_x", "__rank_y") / F.when(scale > 0, scale)).alias(name))


def places(rows: DataFrame, by: Sequence[str], value: str, tie: str, name: str = "place") -> DataFrame:
    """The rows with their place (from 0) in the order of value; rows of one value are told apart by ``tie``.

    A value that many rows share is numbered by the ranges of ``tie`` among its rows.
    """
    first = cumulative(rows.groupBy(*by, value).agg(F.count("*").alias("n")), by, value).select(*by, value, "below", F.col("total").alias(f"{name}s"))
    within = cumulative(rows.groupBy(*by, value, tie).agg(F.count("*").alias("n")), [*by, value], tie).select(*by, value, tie, F.col("below").alias("__inner"))
    out = joined(joined(rows, first, [*by, value]), within, [*by, value, tie])
    return out.withColumn(name, F.col("below") + F.col("__inner")).drop("below", "__inner")
