"""Nearest-neighbour purity and silhouettes within panels.

Neighbours come from matrix products of tiles; means of distances follow from sums of unit
vectors and need no pairs.  A row is never its own neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.columns import safe_ratio
from .diversity import group_sums, with_unit
from .pairs import nearest


def neighbours(samples: DataFrame, panel: Sequence[str], label: str, k: int, index: str = "row_idx") -> DataFrame:
    """The k nearest of each row (i, label_i): j, label_j, distance, rank; ties go to the lower label, then the lower index."""
    return nearest(samples, panel, label, k, index)


def soft_purity(near: DataFrame, panel: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """For each k the mean share of a row's k nearest (or all others) that have its label.  ``near``: at least max(ks) neighbours."""
    near = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    per_row = near.groupBy(*panel, "i", "k").agg(F.avg((F.col("label_i") == F.col("label_j")).cast("double")).alias("share"))
    return per_row.groupBy(*panel, "k").agg(F.count("*").alias("n"), F.avg("share").alias("purity"))


def panel_purity(near: DataFrame, panel: Sequence[str], least: int = 3) -> DataFrame:
    """Purity of the neighbours by label; panels below ``least`` rows are left out."""
    per_row = near.groupBy(*panel, "i", "label_i").agg(F.avg((F.col("label_i") == F.col("label_j")).cast("double")).alias("share"))
    sizes = per_row.groupBy(*panel).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return per_row.join(sizes, list(panel)).groupBy(*panel, F.col("label_i").alias("label")).agg(F.count("*").alias("n"), F.avg("share").alias("purity"))


def label_distances(samples: DataFrame, panel: Sequence[str], label: str) -> DataFrame:
    """Mean distance within a label and to all others, and within over between, by label: from sums of unit vectors."""
    s = group_sums(samples, [*panel, label])
    whole = s.groupBy(*panel).agg(V.vector_sum(F.col("total")).alias("all"), F.sum("n").alias("n_all"))
    j = s.join(whole, list(panel))
    rest = F.zip_with("all", "total", lambda x, y: x - y)
    j = j.withColumn("within", V.mean_pair_distance(F.col("total"), F.col("squares"), F.col("n"))).withColumn("between", V.mean_cross_distance(F.col("total"), rest, F.col("n"), F.col("n_all") - F.col("n")))
    return j.select(*panel, F.col(label).alias("label"), "within", "between", safe_ratio(F.col("within"), F.col("between")).alias("ratio"))


def silhouette(samples: DataFrame, panel: Sequence[str], label: str, index: str = "row_idx") -> DataFrame:
    """Mean silhouette of each panel; single members count 0; null unless there are 2 .. n - 1 labels.

    The mean distance of a row to a label follows from the label's sum of unit vectors, so a row meets labels and not rows.
    """
    u = with_unit(samples).select(*panel, F.col(index).alias("id"), F.col(label).alias("own"), "u")
    sums = group_sums(samples, [*panel, label]).select(*panel, F.col(label).alias("other"), F.col("n").alias("m"), "total")
    j = u.join(sums, list(panel))
    same = F.col("own") == F.col("other")
    to_own = F.when(F.col("m") > 1, 1 - (V.dot(F.col("u"), F.col("total")) - V.dot(F.col("u"), F.col("u"))) / F.when(F.col("m") > 1, F.col("m") - 1))
    to_other = 1 - V.dot(F.col("u"), F.col("total")) / F.col("m")
    row = j.groupBy(*panel, "id", "own").agg(F.max(F.when(same, to_own)).alias("a"), F.min(F.when(~same, to_other)).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.when(top != 0, top))
    out = row.withColumn("s", s).groupBy(*panel).agg(F.count("*").alias("n"), F.countDistinct("own").alias("labels"), F.avg("s").alias("mean"))
    return out.select(*panel, "n", "labels", F.when((F.col("labels") > 1) & (F.col("n") > F.col("labels")), F.col("mean")).alias("silhouette"))


def mean_over_panels(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of a panel measure over panels, leaving out nulls and NaN."""
    v = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*by).agg(F.count(v).alias("n_panels"), F.avg(v).alias("mean_" + value))
