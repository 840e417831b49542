"""Distances within and between groups of vectors.  Means need no pairs: they follow from sums of unit vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.columns import effort_order, is_blank, rate, safe_ratio, stopped_at_limit
from . import pairs as P

GROUP = ("keyword", "effort")


def with_unit(samples: DataFrame, vec: str = "vec") -> DataFrame:
    return samples.withColumn("u", V.unit(V.doubles(F.col(vec))))


def group_sums(samples: DataFrame, by: Sequence[str], vec: str = "vec") -> DataFrame:
    """n, the sum of unit vectors and the sum of their squared norms, by group: all that the closed forms need."""
    u = with_unit(samples, vec)
    return u.groupBy(*by).agg(F.count("u").alias("n"), V.vector_sum(F.col("u")).alias("total"), F.sum(V.dot(F.col("u"), F.col("u"))).alias("squares"))


def mean_pairwise_distance(samples: DataFrame, by: Sequence[str] = GROUP, small: float | None = 0.0) -> DataFrame:
    """Mean cosine distance over all pairs of a group; ``small`` for groups below two."""
    s = group_sums(samples, by)
    mean = V.mean_pair_distance(F.col("total"), F.col("squares"), F.col("n"))
    return s.select(*by, "n", F.coalesce(mean, F.lit(small)).alias("mean_distance"))


def pair_distances(samples: DataFrame, by: Sequence[str] = GROUP, index: str = "row_idx") -> DataFrame:
    """All pairs i < j of a group with their distance, by matrix products of tiles."""
    return P.all_pairs(samples, by, index)


def pair_summary(samples: DataFrame, by: Sequence[str] = GROUP, group: Sequence[str] | None = None, index: str = "row_idx") -> DataFrame:
    """n_pairs, mean, median and population deviation of the distances within ``by``, by ``group`` (some of ``by``)."""
    return P.summary(samples, by, group, index)


def centroids(samples: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Means of raw vectors."""
    return samples.groupBy(*by).agg(V.vector_mean(V.doubles(F.col("vec"))).alias("centroid"), F.count("*").alias("n"))


def centroid_spread(samples: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Mean and population deviation of the cosine distance to the group's centroid, not clipped."""
    c = centroids(samples, by).select(*by, V.unit(F.col("centroid")).alias("cu"))
    d = with_unit(samples).join(c, list(by)).withColumn("d", 1 - V.dot(F.col("u"), F.col("cu")))
    return d.groupBy(*by).agg(F.avg("d").alias("mean_to_centroid"), F.stddev_pop("d").alias("std_to_centroid"))


def centroid_matrix(samples: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Distances of all centroids, in long form: one row for each ordered pair of groups, by matrix products of tiles of groups."""
    name = F.concat_ws("|", *(F.coalesce(F.col(k), F.lit("NA")) for k in by))
    c = centroids(samples, by).select(F.lit(1).alias("__all"), name.alias("i"), V.unit(F.col("centroid")).alias("u"))

    def found(first, second, d):
        return pd.DataFrame({"a": np.repeat(first["i"].to_numpy(), len(second)), "b": np.tile(second["i"].to_numpy(), len(first)), "distance": d.ravel()})

    return P.products(P.tiled(c, ["__all"], ordered=True), ["__all"], found, "a string, b string, distance double").drop("__all")


def keyword_effort_summary(samples: DataFrame, by: Sequence[str] = ("category", "keyword", "effort")) -> DataFrame:
    """One row a group: counts, lengths, rates, tokens, and the distances of mean_pairwise, median and centroid."""
    u = with_unit(samples)
    one = u.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("word_count").alias("mean_word_count"),
        F.avg("char_count").alias("mean_char_count"),
        rate(F.col("has_reasoning_block")).alias("reasoning_block_rate"),
        rate(stopped_at_limit(F.col("stop_reason"))).alias("max_tokens_stop_rate"),
        rate(F.col("validation_status") == "passed").alias("validation_pass_rate"),
        F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg("output_tokens").alias("mean_output_tokens"),
        F.avg("total_tokens").alias("mean_total_tokens"),
        F.max("output_tokens").alias("max_output_tokens"),
        V.vector_sum(F.col("u")).alias("__total"),
        F.sum(V.dot(F.col("u"), F.col("u"))).alias("__squares"),
        V.vector_mean(V.doubles(F.col("vec"))).alias("__centroid"),
    )
    mean = F.coalesce(V.mean_pair_distance(F.col("__total"), F.col("__squares"), F.col("n")), F.lit(0.0))
    one = one.withColumn("mean_pairwise_distance", mean)
    d = u.select(*by, "u").join(one.select(*by, V.unit(F.col("__centroid")).alias("cu")), list(by)).withColumn("d", 1 - V.dot(F.col("u"), F.col("cu")))
    spread = d.groupBy(*by).agg(F.avg("d").alias("mean_to_centroid"), F.stddev_pop("d").alias("std_to_centroid"))
    median = pair_summary(samples, by).select(*by, F.col("median_distance").alias("median_pairwise_distance"))
    out = one.drop("__total", "__squares", "__centroid").join(median, list(by), "left").join(spread, list(by), "left")
    return out.withColumn("median_pairwise_distance", F.coalesce("median_pairwise_distance", F.lit(0.0)))


def effort_summary(rows: DataFrame, means: Sequence[str], total: str = "n", most: str | None = None) -> DataFrame:
    """Keyword-weighted: means of group means, the sum of ``total`` and the maximum of ``most``."""
    aggs = [F.count("*").alias("n_keywords"), F.sum(total).alias("n_samples"), *(F.avg(c).alias(c) for c in means)]
    return rows.groupBy("effort").agg(*aggs, *([F.max(most).alias(most)] if most else []))


def category_summary(rows: DataFrame, value: str) -> DataFrame:
    """By category and effort: mean, population deviation (0 for one row), least and most; blank categories are left out."""
    rows = rows.where(~is_blank(F.col("category")))
    return rows.groupBy("category", "effort").agg(F.count("*").alias("n_keywords"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def cross_within(samples: DataFrame, by: str, side: str) -> DataFrame:
    """For each two sides a < b within a group: mean cross distance, distance of the centroids of raw vectors, and cross over mean within."""
    u = with_unit(samples)
    s = u.groupBy(by, side).agg(F.count("u").alias("n"), V.vector_sum(F.col("u")).alias("total"), F.sum(V.dot(F.col("u"), F.col("u"))).alias("squares"), V.vector_mean(V.doubles(F.col("vec"))).alias("centroid"))
    within = V.mean_pair_distance(F.col("total"), F.col("squares"), F.col("n"))
    s = s.withColumn("within", within)
    a = s.select(by, *(F.col(c).alias(c + "_a") for c in (side, "n", "total", "within", "centroid")))
    b = s.select(by, *(F.col(c).alias(c + "_b") for c in (side, "n", "total", "within", "centroid")))
    j = a.join(b, by).where(F.col(side + "_a") < F.col(side + "_b"))
    cross = V.mean_cross_distance(F.col("total_a"), F.col("total_b"), F.col("n_a"), F.col("n_b"))
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    centroid = 1 - V.dot(V.unit(F.col("centroid_a")), V.unit(F.col("centroid_b")))
    return j.select(
        by,
        side + "_a",
        side + "_b",
        cross.alias("cross_distance"),
        F.when(enough, centroid).alias("centroid_distance"),
        F.when(enough, safe_ratio(cross, (F.col("within_a") + F.col("within_b")) / 2)).alias("cross_within_ratio"),
    )


def separability(samples: DataFrame, group: str = "keyword", within: Sequence[str] = ("effort",)) -> DataFrame:
    """Exact expectations of distances within groups, between different groups and at random, and inter / intra."""
    g = group_sums(samples, [*within, group])
    g = g.withColumn("own", V.dot(F.col("total"), F.col("total")))
    s = g.groupBy(*within).agg(
        V.vector_sum(F.col("total")).alias("all"),
        F.sum("n").alias("n"),
        F.sum("own").alias("own"),
        F.sum("squares").alias("squares"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"),
    )
    all_ = V.dot(F.col("all"), F.col("all"))
    intra = F.when(F.col("pairs") > 0, 1 - (F.col("own") - F.col("squares")) / F.col("pairs"))
    other = F.col("n") * F.col("n") - F.col("nn")
    inter = F.when(other > 0, 1 - (all_ - F.col("own")) / other)
    return s.select(*within, intra.alias("intra"), inter.alias("inter"), (1 - all_ / (F.col("n") * F.col("n"))).alias("random"), safe_ratio(inter, intra).alias("separability"))


def leave_one_out(samples: DataFrame, group: str = "keyword", within: Sequence[str] = ("effort",)) -> DataFrame:
    """Separability without each group, by taking its part from the sums, and the shift against all groups.

    Intra is the unweighted mean of the groups' own mean distances (groups of one row have none); inter is over all
    pairs of different groups.
    """
    g = group_sums(samples, [*within, group]).withColumn("own", V.dot(F.col("total"), F.col("total")))
    g = g.withColumn("intra", V.mean_pair_distance(F.col("total"), F.col("squares"), F.col("n")))
    s = g.groupBy(*within).agg(V.vector_sum(F.col("total")).alias("all"), *(F.sum(c).alias("s_" + c) for c in ("n", "own")), F.sum("intra").alias("s_intra"), F.count("intra").alias("s_have"), F.sum(F.col("n") * F.col("n")).alias("s_nn"))
    j = g.join(s, list(within))
    rest = F.zip_with("all", "total", lambda x, y: x - y)

    def ratio(all_, n, own, nn, intra, have):
        inter = F.when(n * n - nn > 0, 1 - (all_ - own) / (n * n - nn))
        return safe_ratio(inter, F.when(have > 0, intra / have))

    whole = ratio(V.dot(F.col("all"), F.col("all")), *(F.col("s_" + c) for c in ("n", "own", "nn", "intra", "have")))
    j = j.withColumn("rest", rest)
    have = F.col("s_have") - F.col("intra").isNotNull().cast("int")
    intra = F.col("s_intra") - F.coalesce("intra", F.lit(0.0))
    left = ratio(V.dot(F.col("rest"), F.col("rest")), F.col("s_n") - F.col("n"), F.col("s_own") - F.col("own"), F.col("s_nn") - F.col("n") * F.col("n"), intra, have)
    return j.select(*within, group, left.alias("separability"), (left - whole).alias("shift"))


def most_influential(loo: DataFrame, group: str = "keyword", within: Sequence[str] = ("effort",)) -> DataFrame:
    return loo.groupBy(*within).agg(F.max_by(group, F.when(F.col("shift").isNotNull(), F.struct(F.abs("shift"), F.col(group)))).alias(group), F.max(F.abs("shift")).alias("largest_shift"))


def per_group_variation(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Coefficient of variation across groups."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn("cv", safe_ratio(F.col("std"), F.col("mean")))


def pivot_efforts(rows: DataFrame, by: Sequence[str], value: str, efforts: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).pivot("effort", list(efforts)).agg(F.first(value))


def low_high_change(rows: DataFrame, by: Sequence[str], value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Absolute and relative change from the low to the high tier; denominators are at least 1e-9."""
    at = {e: F.max(F.when(F.col("effort") == e, F.col(value))) for e in (low, high)}
    s = rows.groupBy(*by).agg(at[low].alias("low"), at[high].alias("high"))
    return s.withColumn("change", F.col("high") - F.col("low")).withColumn("relative_change", F.col("change") / F.greatest(F.col("low"), F.lit(1e-9)))


def ordered_by_effort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys, effort_order(F.col("effort")))
