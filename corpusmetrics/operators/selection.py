"""Choosing pairs and groups: extremes, middles, quartiles, splits and seeded samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pairs as P


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence, m: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= m)


def stratified_pairs(samples: DataFrame, by: Sequence[str], m: int, middle: int | None = None, short: str = "raise", index: str = "row_idx") -> DataFrame:
    """The m farthest, the m nearest and the ``middle`` ones around the median rank of each group of vectors, ranked from 1.

    The farthest are ranked from far to near, the others from near to far.  A pair may stand in two strata.  Where a
    group has fewer than ``middle`` pairs, the query fails, or takes all of them with short = "all".
    """
    middle = m if middle is None else middle
    tiles = P.tiled(P.unit_rows(samples, by, index), by)
    ends = P.extremes(tiles, by, m)
    out = []
    for name, order in (("top", F.desc("distance")), ("bottom", F.asc("distance"))):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, "i", "j"))
        out.append(ends.withColumn("stratum", F.lit(name)).withColumn("rank", rank).where(F.col("rank") <= m))
    if middle > 0:
        start = F.greatest(F.lit(0), F.floor((F.col("__size") - middle) / 2))
        hist = P.histogram(tiles, by)
        wanted = P.between_ranks(hist, by, start + 1, start + middle)
        if short == "raise":
            enough = F.col("__size") >= middle
            wanted = wanted.withColumn("__size", F.when(enough, F.col("__size")).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {middle} pairs in "), F.concat_ws(", ", *(F.col(c).cast("string") for c in by)))).cast("long")))
        near = P.in_bins(tiles, by, by, wanted).join(wanted, [*by, "bin"])
        rank = F.row_number().over(Window.partitionBy(*by, "bin").orderBy("distance", "i", "j")) + F.col("__below") - start
        near = near.withColumn("stratum", F.lit("middle")).withColumn("rank", rank.cast("int")).where((F.col("rank") >= 1) & (F.col("rank") <= middle))
        out.append(near.drop("bin", "__below", "__size"))
    return reduce(DataFrame.unionByName, out).select(*by, "i", "j", "distance", "stratum", "rank")


def too_few_pairs(samples: DataFrame, by: Sequence[str], middle: int) -> DataFrame:
    """Groups in which ``middle`` pairs around the median can't be chosen."""
    n = F.count("*")
    return samples.groupBy(*by).agg((n * (n - 1) / 2).cast("long").alias("n_pairs")).where(F.col("n_pairs") < middle)


def judge_requests(pairs: DataFrame, texts: DataFrame, judge: str, both_orders: bool = True) -> DataFrame:
    """Two texts for each pair, in one order or both."""
    a = texts.select(F.col("row_idx").alias("i"), F.col("idea").alias("text_i"))
    b = texts.select(F.col("row_idx").alias("j"), F.col("idea").alias("text_j"))
    orders = F.array(*map(F.lit, ("ab", "ba") if both_orders else ("ab",)))
    out = pairs.join(a, "i").join(b, "j").withColumn("judge", F.lit(judge)).withColumn("order", F.explode(orders))
    ab = F.col("order") == "ab"
    return out.withColumn("text_a", F.when(ab, F.col("text_i")).otherwise(F.col("text_j"))).withColumn("text_b", F.when(ab, F.col("text_j")).otherwise(F.col("text_i"))).drop("text_i", "text_j")


def quartile_pools(rows: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Q1: the first floor(n / 4) in ascending order, Q4: the last ones."""
    w = Window.partitionBy(*by).orderBy(value, key)
    r = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    q = F.floor(F.col("__n") / 4)
    stratum = F.when(F.col("__rn") <= q, "Q1").when(F.col("__rn") > F.col("__n") - q, "Q4")
    return r.withColumn("stratum", stratum).where("stratum is not null").drop("__rn", "__n")


def median_split(rows: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value, key)
    r = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    return r.withColumn("half", F.when(F.col("__rn") <= F.floor(F.col("__n") / 2), "lower").otherwise("upper")).drop("__rn", "__n")


def seeded_sample(rows: DataFrame, by: Sequence[str], key: Sequence[str], n: int, seed: int = 42, short: str = "raise") -> DataFrame:
    """n rows of each group without replacement, the same for a seed whatever the partitioning.

    Where a group has fewer than n rows, the query fails, or takes all of them with short = "all".
    """
    order = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in key), F.lit(str(seed))).cast("binary"))
    if short == "raise":
        size = F.count("*").over(Window.partitionBy(*by))
        error = F.raise_error(F.concat(F.lit(f"fewer than {n} rows in "), F.concat_ws(", ", *(F.col(c).cast("string") for c in by))))
        rows = rows.withColumn("__size", size).where(F.when(F.col("__size") >= n, F.lit(True)).otherwise(error.cast("boolean"))).drop("__size")
    return top_per_group(rows, by, [order, *key], n, "__r").drop("__r")


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    return top_per_group(rows, by, order, 1, "__r").drop("__r")


def positional_join(a: DataFrame, b: DataFrame, by: Sequence[str], order_a: Sequence, order_b: Sequence) -> DataFrame:
    """Rows of two tables paired by their rank within the group."""
    x = a.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order_a)))
    y = b.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order_b)))
    return x.join(y, [*by, "__r"], "full").drop("__r")


def overlap(selected: DataFrame, by: Sequence[str], key: str, model: str) -> DataFrame:
    """How many keys are selected by 1, 2, .. models."""
    per_key = selected.groupBy(*by, key).agg(F.countDistinct(model).alias("n_models"))
    return per_key.groupBy(*by, "n_models").agg(F.count("*").alias("n_keys"))
