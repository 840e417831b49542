"""Contrasts of cells (a prompt kind and a tier): gains, quality changes, separability and paired effects, by stratum of keywords.

A cell has one value for each keyword; a contrast pairs two cells by keyword.  Tests and intervals
run on the values of one contrast and stratum, of which there are as many as keywords.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import vectors as V
from ..functions.columns import safe_ratio
from .diversity import with_unit
from .neighbours import neighbours
from .selection import median_split, quartile_pools, seeded_sample
from .statistics import benjamini_hochberg

STRATA = ("Q1", "Q4")


def sides(cells: DataFrame, contrasts: Sequence[tuple[str, str, str, str]], value: Sequence[str]) -> DataFrame:
    """contrast, keyword, lhs_*, rhs_* of keywords that both cells of a contrast (kind, tier; kind, tier) have."""
    out = []
    for side, at in (("lhs", 0), ("rhs", 2)):
        named = F.array(*(F.struct(F.lit(label(c)).alias("contrast"), F.lit(c[at]).alias("k"), F.lit(c[at + 1]).alias("e")) for c in contrasts))
        own = F.filter(named, lambda c: (c["k"] == F.col("kind")) & (c["e"] == F.col("effort")))
        out.append(cells.withColumn("__c", F.explode(own)).select(F.col("__c.contrast").alias("contrast"), "keyword", *(F.col(v).alias(f"{side}_{v}") for v in value)))
    return out[0].join(out[1], ["contrast", "keyword"])


def label(contrast: tuple[str, str, str, str]) -> str:
    a, b, c, d = contrast
    return f"{a}-{b} vs {c}-{d}"


def gains(cells: DataFrame, strata: DataFrame, contrasts: Sequence[tuple[str, str, str, str]], value: str = "value") -> DataFrame:
    """contrast, keyword, stratum, abs_gain = lhs - rhs, rel_gain = abs_gain / rhs; keywords without either are left out."""
    s = sides(cells, contrasts, [value]).join(strata.select("keyword", "stratum"), "keyword")
    gain = F.col(f"lhs_{value}") - F.col(f"rhs_{value}")
    out = s.select("contrast", "keyword", "stratum", gain.alias("abs_gain"), safe_ratio(gain, F.col(f"rhs_{value}")).alias("rel_gain"))
    return out.where("abs_gain is not null and rel_gain is not null")


def gain_means(rows: DataFrame, by: Sequence[str] = ("contrast",), values: Sequence[str] = ("abs_gain", "rel_gain")) -> DataFrame:
    """By contrast: keywords and means of either stratum, and the ratio of the means of Q1 and Q4."""
    cells = []
    for s in STRATA:
        own = F.col("stratum") == s
        cells.append(F.count_if(own).alias(f"n_{s.lower()}"))
        cells += [F.avg(F.when(own, F.col(v))).alias(f"{v}_{s.lower()}") for v in values]
    out = rows.groupBy(*by).agg(*cells)
    ratio = lambda v: F.when(F.abs(F.col(f"{v}_q4")) >= 1e-9, F.col(f"{v}_q1") / F.col(f"{v}_q4"))
    return out.select("*", *(ratio(v).alias(f"{v}_ratio") for v in values))


def _nan_to_none(x: float):
    return None if x is None or np.isnan(x) else float(x)


def gain_tests(rows: DataFrame, by: Sequence[str] = ("contrast",), values: Sequence[str] = ("abs_gain", "rel_gain"), zeros: str = "wilcox", least: int = 6, n_boot: int = 10_000, seed: int = 42, family: Sequence[str] = ()) -> DataFrame:
    """Intervals of the means and ratios, signed-rank p of either stratum and rank-sum p between them, with p adjusted over all of a run (each value of ``family``).

    p are taken of the first value: the relative one orders keywords alike.  Strata below ``least`` keywords, or without any change, have none.
    """
    by = list(by)
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {s: pdf[pdf["stratum"] == s] for s in STRATA}
        out = {c: pdf[c].iloc[0] for c in by}
        for v in values:
            side = {s: np.sort(at[s][v].dropna().to_numpy(float)) for s in STRATA}
            for s in STRATA:
                lo, hi = K.bootstrap_ci(side[s], K.seed_of(*(out[c] for c in by), v, s, base=seed), n_boot)
                out |= {f"{v}_{s.lower()}_ci_low": lo, f"{v}_{s.lower()}_ci_high": hi}
            _, lo, hi = K.bootstrap_ratio_ci(side["Q1"], side["Q4"], K.seed_of(*(out[c] for c in by), v, base=seed), n_boot)
            out |= {f"{v}_ratio_ci_low": lo, f"{v}_ratio_ci_high": hi}
        first = {s: at[s][values[0]].dropna().to_numpy(float) for s in STRATA}
        for s in STRATA:
            enough = len(first[s]) >= least and first[s].any()
            out[f"wilcoxon_{s.lower()}_p"] = K.wilcoxon_p(first[s], "two-sided", zeros)[1] if enough else np.nan
        out["mannwhitney_p"] = K.mannwhitney_p(first["Q1"], first["Q4"])[1]
        return pd.DataFrame([{k: v if k in by else _nan_to_none(v) for k, v in out.items()}])

    cis = [f"{v}_{x}_ci_{e}" for v in values for x in ("q1", "q4", "ratio") for e in ("low", "high")]
    ps = ["wilcoxon_q1_p", "wilcoxon_q4_p", "mannwhitney_p"]
    kind = ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{c} double" for c in [*cis, *ps])])
    tested = rows.select(*by, "stratum", *values).groupBy(*by).applyInPandas(run, kind)
    # a family is all p of the table: a few for each contrast
    long = benjamini_hochberg(tested.unpivot(by, ps, "test", "p").withColumn("__run", F.lit(1)), "p", ["__run", *family])
    adjusted = long.groupBy(*by).pivot("test", ps).agg(F.first("p_adjusted"))
    return tested.join(adjusted.select(*by, *(F.col(p).alias(f"{p}_fdr") for p in ps)), by)


def quality_deltas(cells: DataFrame, strata: DataFrame, contrasts: Sequence[tuple[str, str, str, str]], axes: Sequence[str]) -> DataFrame:
    """contrast, axis, keyword, stratum, delta of each axis and of their mean ('avg', over the axes that both cells have)."""
    s = sides(cells, contrasts, axes).join(strata.select("keyword", "stratum"), "keyword")
    delta = {a: F.col(f"lhs_{a}") - F.col(f"rhs_{a}") for a in axes}
    have = F.filter(F.array(*delta.values()), lambda x: x.isNotNull())
    mean = F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, b: a + b) / F.size(have))
    cells = F.array(*(F.struct(F.lit(a).alias("axis"), d.alias("delta")) for a, d in [*delta.items(), ("avg", mean)]))
    return s.select("contrast", "keyword", "stratum", F.explode(cells).alias("c")).select("contrast", "c.axis", "keyword", "stratum", "c.delta").where("delta is not null")


def quartile_strata(cells: DataFrame, value: str = "value", per_stratum: int | None = None, excluded: Sequence[str] = (), kind: str = "default", effort: str = "low", seed: int = 42, short: str = "raise") -> DataFrame:
    """keyword, stratum: the lowest (Q1) and highest (Q4) quarter, floor(n / 4) each, of keywords by their value in the base cell.

    ``per_stratum``: so many of each are drawn without replacement, by seed; ``excluded`` keywords go after the draw, so
    the others stay the same.  A pool smaller than the draw raises, or is taken whole with short = "all".
    """
    base = cells.where((F.col("kind") == kind) & (F.col("effort") == effort)).select("keyword", F.round(value, 9).alias("base")).where("base is not null")
    pools = quartile_pools(base.withColumn("__run", F.lit(1)), ["__run"], "base", "keyword").select("keyword", "stratum")
    if per_stratum is not None:
        pools = seeded_sample(pools, ["stratum"], ["keyword"], per_stratum, seed, short)
    return pools.where(~F.col("keyword").isin(list(excluded))) if excluded else pools


def with_skipped(table: DataFrame, cells: DataFrame, contrasts: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """The table with a row for every contrast; ``skipped`` says 'missing cell' where no keyword has one of its cells."""
    have = cells.select("kind", "effort").distinct()
    asked = cells.sparkSession.createDataFrame([(label(c), *c) for c in contrasts], "contrast string, lk string, le string, rk string, re string")
    for side in "lr":
        named = have.select(F.col("kind").alias(f"{side}k"), F.col("effort").alias(f"{side}e"), F.lit(True).alias(f"has_{side}"))
        asked = asked.join(named, [f"{side}k", f"{side}e"], "left")
    missing = F.when(F.col("has_l").isNull() | F.col("has_r").isNull(), "missing cell")
    return asked.select("contrast", missing.alias("skipped")).join(table, "contrast", "left")


def baseline_strata(cells: DataFrame, axes: Sequence[str], kind: str = "default", effort: str = "low") -> DataFrame:
    """keyword, stratum: the lower (Q1) and upper (Q4) half of keywords by their mean score in the base cell."""
    mean = sum((F.col(a) for a in axes[1:]), F.col(axes[0])) / len(axes)
    base = cells.where((F.col("kind") == kind) & (F.col("effort") == effort)).select("keyword", F.round(mean, 9).alias("base")).where("base is not null")
    halves = median_split(base.withColumn("__run", F.lit(1)), ["__run"], "base", "keyword")
    return halves.select("keyword", F.when(F.col("half") == "lower", "Q1").otherwise("Q4").alias("stratum"))


def paired_effects(values: DataFrame, comparisons: Sequence[tuple[str, str]], value: str = "value", least: int = 2) -> DataFrame:
    """comparison, n_keywords, mean_baseline, mean_treatment, mean_diff, cohens_dz of keywords that have both tiers."""
    d = paired_differences(values, comparisons, value)
    s = F.stddev_samp("diff")
    out = d.groupBy("comparison").agg(F.count("*").alias("n_keywords"), F.avg("base").alias("mean_baseline"), F.avg("treatment").alias("mean_treatment"), F.avg("diff").alias("mean_diff"), F.when(s > 0, F.avg("diff") / F.when(s > 0, s)).alias("cohens_dz"))
    return out.where(F.col("n_keywords") >= least)


def paired_differences(values: DataFrame, comparisons: Sequence[tuple[str, str]], value: str = "value") -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in comparisons))
    v = values.groupBy("keyword").agg(F.map_from_entries(F.collect_list(F.struct("effort", F.col(value).cast("double")))).alias("m")).withColumn("c", F.explode(pairs))
    at = lambda c: F.try_element_at("m", F.col(c))
    d = v.select(F.concat_ws("_vs_", "c.a", "c.b").alias("comparison"), "keyword", at("c.a").alias("base"), at("c.b").alias("treatment"))
    return d.where("base is not null and treatment is not null").withColumn("diff", F.col("treatment") - F.col("base"))


def cell_separation(samples: DataFrame, contrasts: Sequence[tuple[str, str, str, str]], ks: Sequence[int] = (1,)) -> DataFrame:
    """contrast, keyword, purity_k (share of a row's k nearest on the union that are of its cell), centroid_distance, cross_within_ratio.

    Keywords with fewer than two rows in either cell are left out.
    """
    sidesof = F.array(*(F.struct(F.lit(label(c)).alias("contrast"), F.lit(side).alias("side"), F.lit(c[at]).alias("k"), F.lit(c[at + 1]).alias("e")) for c in contrasts for side, at in (("lhs", 0), ("rhs", 2))))
    rows = samples.withColumn("__c", F.explode(F.filter(sidesof, lambda c: (c["k"] == F.col("kind")) & (c["e"] == F.col("effort")))))
    rows = rows.select("__c.contrast", "__c.side", "keyword", "row_idx", "vec")
    u = with_unit(rows)
    s = u.groupBy("contrast", "keyword", "side").agg(F.count("u").alias("n"), V.vector_sum(F.col("u")).alias("total"), F.sum(V.dot(F.col("u"), F.col("u"))).alias("q"), V.vector_mean(V.doubles(F.col("vec"))).alias("centroid"))
    s = s.where("n > 1").withColumn("within", V.mean_pair_distance(F.col("total"), F.col("q"), F.col("n")))
    a, b = (s.where(F.col("side") == x).select("contrast", "keyword", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "total", "within", "centroid"))) for x in ("lhs", "rhs"))
    both = a.join(b, ["contrast", "keyword"])
    cross = V.mean_cross_distance(F.col("total_lhs"), F.col("total_rhs"), F.col("n_lhs"), F.col("n_rhs"))
    within = (F.col("within_lhs") + F.col("within_rhs")) / 2
    both = both.select("contrast", "keyword", (1 - V.dot(V.unit(F.col("centroid_lhs")), V.unit(F.col("centroid_rhs")))).alias("centroid_distance"), F.when(within > 0, cross / F.when(within > 0, within)).alias("cross_within_ratio"))
    near = neighbours(rows, ["contrast", "keyword"], "side", max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    share = near.groupBy("contrast", "keyword", "i", "k").agg(F.avg((F.col("label_i") == F.col("label_j")).cast("double")).alias("share"))
    purity = share.groupBy("contrast", "keyword").pivot("k", list(ks)).agg(F.avg("share"))
    return both.join(purity.select("contrast", "keyword", *(F.col(str(k)).alias(f"purity_{k}") for k in ks)), ["contrast", "keyword"])


def separation_means(rows: DataFrame, strata: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """contrast, stratum, n and the mean of each metric over the keywords that have it; n counts all keywords of the stratum."""
    means = rows.join(strata.select("keyword", "stratum"), "keyword").groupBy("contrast", "stratum").agg(*(F.avg(m).alias(m) for m in metrics))
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("n"))
    every = rows.select("contrast").distinct().crossJoin(F.broadcast(sizes))  # two strata
    return every.join(means, ["contrast", "stratum"], "left").select("contrast", "stratum", "n", *metrics)


def roll_up(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Least, median, largest and range of a measure over what is not in ``by``."""
    return rows.groupBy(*by).agg(F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("range"))


def one_by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The one row whose ``column`` begins with ``prefix``; the query fails unless there is exactly one."""
    own = rows.where(F.col(column).startswith(prefix)).limit(2)
    n = F.count("*")
    cells = [F.first(c).alias(c) for c in rows.columns]
    found = own.agg(n.alias("__n"), *cells)
    right = F.when(F.col("__n") == 1, F.col(rows.columns[0])).otherwise(F.raise_error(F.concat(F.lit(f"not one row for {prefix!r}: "), F.col("__n").cast("string"))).cast(rows.schema[0].dataType))
    return found.select(right.alias(rows.columns[0]), *rows.columns[1:])
