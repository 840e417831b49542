"""Multi-axis quality scores: means, changes between tiers, agreement of judges and decision rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import guarded_corr
from ..functions.constants import AXES, CALIBRATION_LEAST, CALIBRATION_MEAN, CALIBRATION_ROWS, EFFORTS, TREND_TOLERANCE
from .checks import unique


def per_keyword_wide(scores: DataFrame, by: Sequence[str], axes: Sequence[str], efforts: Sequence[str], low: str | None = None, high: str = "high") -> DataFrame:
    """Means of each axis by tier as columns, complete keywords only, and the change from ``low`` (or the lowest tier present) to ``high``.

    Tiers that no row has are left out.
    """
    have = {x[0] for x in scores.where(F.col("effort").isin(*efforts)).select("effort").distinct().collect()}  # one row a tier
    efforts = [e for e in efforts if e in have]
    if high not in efforts:
        raise ValueError(f"tier {high!r} is needed for the change")
    low = low or efforts[0]
    means = [F.avg(F.when(F.col("effort") == e, F.col(a))).alias(f"{a}_{e}") for a in axes for e in efforts]
    wide = scores.groupBy(*by).agg(*means).na.drop(subset=[f"{a}_{e}" for a in axes for e in efforts])
    return wide.select("*", *((F.col(f"{a}_{high}") - F.col(f"{a}_{low}")).alias(f"{a}_delta") for a in axes))


def wide_to_long(wide: DataFrame, by: Sequence[str], axes: Sequence[str], efforts: Sequence[str]) -> DataFrame:
    """Columns axis_effort back to rows; tiers without a column are left out."""
    have = [(a, e) for a in axes for e in efforts if f"{a}_{e}" in wide.columns]
    cells = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(e).alias("effort"), F.col(f"{a}_{e}").cast("double").alias("score")) for a, e in have))
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.axis", "c.effort", "c.score")


def unpivot_axes(scores: DataFrame, keep: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    return scores.unpivot(list(keep), list(axes), "axis", "score")


def by_effort(scores: DataFrame, axes: Sequence[str], efforts: Sequence[str] = EFFORTS) -> DataFrame:
    """Mean over keyword means for every tier; tiers without rows have nulls."""
    per = scores.groupBy("keyword", "effort").agg(*(F.avg(a).alias(a) for a in axes))
    means = per.groupBy("effort").agg(F.count("*").alias("n_keywords"), *(F.avg(a).alias(a) for a in axes))
    tiers = scores.sparkSession.createDataFrame([(e,) for e in efforts], "effort string")
    # one row a tier
    return F.broadcast(tiers).join(means, "effort", "left").na.fill(0, ["n_keywords"])


def joint(a: DataFrame, b: DataFrame, key: Sequence[str], axes: Sequence[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Scores of two judges side by side for what both judged; raises where a judge has a key twice."""
    x = a.select(*key, *(F.col(c).alias(c + suffixes[0]) for c in axes))
    y = b.select(*key, *(F.col(c).alias(c + suffixes[1]) for c in axes))
    return unique(x, key).join(unique(y, key), list(key))


def score_matrix(both: DataFrame, a: str, b: str, values: Sequence[int]) -> DataFrame:
    """Counts and percentages for every two scores."""
    from .judgments import confusion

    m = confusion(both, a, b, values)
    total = both.agg(F.count("*").alias("total"))
    # a one-row table
    return m.crossJoin(F.broadcast(total)).select("a", "b", "n", F.when(F.col("total") > 0, 100 * F.col("n") / F.col("total")).alias("percent"))


def condition_means(long: DataFrame, by: Sequence[str]) -> DataFrame:
    return long.where("score is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))


def trend(means: DataFrame, by: Sequence[str], condition: str, low: str, high: str, tolerance: float = TREND_TOLERANCE) -> DataFrame:
    """Change of the mean from one condition to another, and whether it is below the tolerance; groups lacking one are left out."""
    at = {c: F.max(F.when(F.col(condition) == c, F.col("mean"))) for c in (low, high)}
    s = means.groupBy(*by).agg(at[low].alias("low"), at[high].alias("high")).where("low is not null and high is not null")
    return s.withColumn("delta", F.col("high") - F.col("low")).withColumn("flat", F.abs(F.col("delta")) < tolerance)


def calibration_r(strong: DataFrame, weak: DataFrame, key: Sequence[str], by: Sequence[str], least_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """Correlation of two judges over shared texts by group; repeated keys multiply rows; groups of few rows are left out."""
    s = strong.where("score is not null").select(*key, F.col("score").alias("strong_score"), F.col("judge").alias("strong"))
    w = weak.where("score is not null").select(*key, F.col("score").alias("weak_score"), F.col("judge").alias("weak"))
    r = s.join(w, list(key)).groupBy(*by, "strong", "weak").agg(F.count("*").alias("n"), guarded_corr("strong_score", "weak_score").alias("r"))
    return r.where(F.col("n") >= least_rows).withColumn("passes", F.coalesce(F.col("r") >= CALIBRATION_LEAST, F.lit(False)))


def decide(trends: DataFrame, calibration: DataFrame) -> DataFrame:
    """One row: path A (both criteria hold), B (trend only) or C."""
    t = trends.agg(F.coalesce(F.bool_and("flat"), F.lit(True)).alias("trend_pass"))
    per = calibration.groupBy("strong", "weak").agg(F.avg("r").alias("mean_r"), F.min("r").alias("least_r"))
    c = per.agg(F.coalesce(F.bool_and(F.coalesce((F.col("mean_r") >= CALIBRATION_MEAN) & (F.col("least_r") >= CALIBRATION_LEAST), F.lit(False))), F.lit(True)).alias("calibration_pass"))
    # two one-row tables
    path = F.when(~F.col("trend_pass"), "C").when(F.col("calibration_pass"), "A").otherwise("B")
    return t.crossJoin(c).withColumn("path", path)


def change_against(rows: DataFrame, base: DataFrame, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean and largest absolute difference of ``score`` between two tables."""
    d = rows.select(*key, *[c for c in by if c not in key], "score").join(base.select(*key, F.col("score").alias("base")), list(key))
    gap = F.abs(F.col("score") - F.col("base"))
    s = d.groupBy(*by) if by else d.groupBy()
    return s.agg(F.count("*").alias("n"), F.avg(gap).alias("mean_change"), F.max(gap).alias("largest_change"))


def mean_of_axes(scores: DataFrame, by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    total = sum((F.col(a) for a in axes[1:]), F.col(axes[0]))
    return scores.groupBy(*by).agg(F.avg(total / len(axes)).alias("quality"))
