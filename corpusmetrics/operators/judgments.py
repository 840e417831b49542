"""Statistics of ordinal labels that judges gave to pairs: distributions, consistency, agreement, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.columns import guarded_corr, label_order, label_points
from ..functions.constants import BIN_EDGES, LABELS
from .ranks import joined, spearman


def _counts(answer: str = "answer") -> list[Column]:
    n = F.count("*")
    one = {x: F.count_if(F.col(answer) == x) for x in LABELS}
    return [n.alias("n"), *(one[x].alias("n_" + x) for x in LABELS), *((one[x] / n).alias("frac_" + x) for x in LABELS), ((one["A"] + one["B"]) / n).alias("frac_AB"), ((one["C"] + one["D"]) / n).alias("frac_CD")]


def label_distribution(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and shares of the labels; with by = (.., rank) the saturation by rank."""
    return judged.groupBy(*by).agg(*_counts())


def label_grouping_sets(judged: DataFrame, by: Sequence[str], total: str) -> DataFrame:
    """label_distribution by ``by`` and ``total``, and once more over all values of ``total`` ('all')."""
    rows = judged.withColumn("__all", F.explode(F.array(F.col(total), F.lit("all"))))
    return rows.groupBy(*by, F.col("__all").alias(total)).agg(*_counts())


def fluency(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    points = label_points(F.col("answer"))
    return judged.groupBy(*by).agg(F.count(points).alias("n"), (F.sum(points) / F.count(points)).alias("fluency"))


def fluency_lift(scores: DataFrame, by: Sequence[str], low: str = "low", high: str = "high") -> DataFrame:
    at = {e: F.max(F.when(F.col("effort") == e, F.col("fluency"))) for e in (low, high)}
    return scores.groupBy(*by).agg(at[low].alias("low"), at[high].alias("high")).withColumn("lift", F.col("high") - F.col("low"))


def distance_by_label(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sample deviation, 0 for a single row."""
    return judged.groupBy(*by, "answer").agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.percentile("distance", F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("std"))


def attribution(judged: DataFrame, by: Sequence[str]) -> DataFrame:
    """distance_by_label with the 10th and 90th percentile."""
    q = F.percentile("distance", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    s = judged.groupBy(*by, "answer").agg(F.count("*").alias("n"), F.avg("distance").alias("mean"), F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("std"), q.alias("q"))
    return s.select(*by, "answer", "n", "mean", "std", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))


def facet_distances(pairs: DataFrame, vectors: DataFrame, facet: str = "facet") -> DataFrame:
    """``pairs`` (i, j, ..) with the distance of their vectors in every facet, looked up by row index."""
    u = vectors.select("row_idx", facet, V.unit(V.doubles(F.col("vec"))).alias("u"))
    a, b = (u.select(F.col("row_idx").alias(k), facet, F.col("u").alias("u" + k)) for k in "ij")
    j = pairs.join(a, "i").join(b, ["j", facet])
    return j.select(*pairs.columns, facet, V.cosine_distance(F.col("ui"), F.col("uj")).alias("facet_distance"))


def collapse_orders(judged: DataFrame, pair: Sequence[str]) -> DataFrame:
    """One row a pair: the label farthest towards A of its orders."""
    return judged.groupBy(*pair).agg(F.min("answer").alias("answer"), F.min_by("distance", "order").alias("distance"))


def calibration(pairs: DataFrame, by: Sequence[str] = ("effort",), edges: Sequence[float] = BIN_EDGES) -> DataFrame:
    """Labels by tier and half-open bins of distance; what lies beyond the last edge is left out."""
    bins = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    own = F.element_at(F.filter(bins, lambda b: (F.col("distance") >= b["lo"]) & (F.col("distance") < b["hi"])), 1)
    inside = pairs.where((F.col("distance") >= edges[0]) & (F.col("distance") < edges[-1])).withColumn("bin", own)
    return inside.groupBy(*by, "bin.lo", "bin.hi").agg(*_counts(), F.avg("distance").alias("mean_distance"))


def beyond_bins(pairs: DataFrame, edges: Sequence[float] = BIN_EDGES) -> DataFrame:
    return pairs.agg(F.count_if(F.col("distance") >= edges[-1]).alias("n_beyond"))


def both_orders(judged: DataFrame, pair: Sequence[str]) -> DataFrame:
    """answer_ab and answer_ba of the pairs that have both."""
    ab = judged.where("order = 'ab'").select(*pair, F.col("answer").alias("answer_ab"))
    ba = judged.where("order = 'ba'").select(*pair, F.col("answer").alias("answer_ba"))
    return ab.join(ba, list(pair))


def consistency(both: DataFrame, by: Sequence[str], a: str = "answer_ab", b: str = "answer_ba") -> DataFrame:
    """Exact, adjacent and far pairs of labels."""
    gap = F.abs(label_order(F.col(a)) - label_order(F.col(b)))
    s = both.groupBy(*by) if by else both.groupBy()
    n = F.count("*")
    return s.agg(n.alias("n"), F.count_if(gap == 0).alias("n_exact"), F.count_if(gap == 1).alias("n_adjacent"), F.count_if(gap > 1).alias("n_far"), (F.count_if(gap == 0) / n).alias("consistency"))


def confusion(both: DataFrame, a: str, b: str, labels: Sequence = LABELS) -> DataFrame:
    """Counts for every two labels, also those that never meet."""
    spark = both.sparkSession
    kind = dict(both.dtypes)[a]
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], f"a {kind}, b {kind}")
    seen = both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    # the grid has len(labels)**2 rows
    return F.broadcast(grid).join(seen, ["a", "b"], "left").na.fill(0, ["n"])


def kappa(both: DataFrame, by: Sequence[str], a: str, b: str, labels: Sequence = LABELS) -> DataFrame:
    """n, exact agreement, plain and quadratic-weighted Cohen's kappa over fixed labels; null without expected disagreement.

    From one aggregation: the quadratic form needs sums and squares, the plain form the counts of each label.
    """
    if list(labels) == list(LABELS):
        x, y = label_order(F.col(a)).cast("double"), label_order(F.col(b)).cast("double")
    else:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count("*")
    aggs = [n.alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"), F.sum((x - y) * (x - y)).alias("o"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy")]
    aggs += [c for k, v in enumerate(labels) for c in (F.count_if(F.col(a) == v).alias(f"a{k}"), F.count_if(F.col(b) == v).alias(f"b{k}"))]
    s = both.groupBy(*by).agg(*aggs) if by else both.agg(*aggs)
    chance = sum((F.col(f"a{k}") * F.col(f"b{k}") for k in range(len(labels))), F.lit(0)) / (F.col("n") * F.col("n"))
    e = F.col("sxx") + F.col("syy") - 2 * F.col("sx") * F.col("sy") / F.col("n")
    s = s.withColumn("chance", chance).withColumn("e", e)
    return s.select(*by, "n", "agreement", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"), F.when(F.abs("e") > 1e-9, 1 - F.col("o") / F.col("e")).alias("weighted_kappa"))


def axis_agreement(both: DataFrame, axis: str, a: str, b: str) -> DataFrame:
    """By axis: n, Pearson, Spearman (mean ranks), mean absolute difference and means."""
    values = both.groupBy(axis).agg(F.count("*").alias("n"), guarded_corr(a, b).alias("pearson"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    order = [axis, "n", "pearson", "spearman", "mean_abs_diff", "mean_a", "mean_b"]
    return joined(values, spearman(both, [axis], a, b), [axis]).select(*order)


def compute_curve(samples: DataFrame, distances: DataFrame, judged: DataFrame) -> DataFrame:
    """By keyword and effort: generation tokens, mean distance, and the share of A in the top stratum and overall."""
    g = ["keyword", "effort"]
    tokens = samples.groupBy(*g).agg(F.avg("generation_tokens").alias("mean_tokens"), F.percentile("generation_tokens", F.lit(0.5)).alias("median_tokens"))
    is_a = (F.col("answer") == "A").cast("double")
    shares = judged.groupBy(*g).agg(F.avg(F.when(F.col("stratum") == "top", is_a)).alias("frac_A_top"), F.avg(is_a).alias("frac_A"))
    return tokens.join(distances.select(*g, "mean_distance"), g, "left").join(shares, g, "left")
