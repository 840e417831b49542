"""Token cost: usage by group, cost of calls that gave several texts, and what diversity costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import effort_order, guarded_corr, safe_ratio
from .selection import first_rows

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def usage(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, population deviation, extremes and quantiles; groups without a value have zeros."""
    q = F.percentile(value, F.array(*map(F.lit, QUANTILES)))
    s = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("q"))
    cols = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std", "least", "most")]
    return s.select(*by, "n", *cols, *(F.coalesce(F.col("q")[k], F.lit(0.0)).alias(f"p{round(100 * x)}") for k, x in enumerate(QUANTILES)))


def calls(samples: DataFrame, by: Sequence[str], per_call: int) -> DataFrame:
    """One row a call: the first of each ``per_call`` samples, whose token fields are those of the call."""
    s = samples.withColumn("call", F.floor(F.col("sample_index") / per_call).cast("long"))
    return first_rows(s, [*by, "call"], ["sample_index"])


def call_totals(call_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    fields = ("input_tokens", "output_tokens", "total_tokens", "reasoning_tokens")
    visible = F.col("total_tokens") - F.col("input_tokens") - F.col("reasoning_tokens")
    return call_rows.groupBy(*by).agg(F.count("*").alias("n_calls"), *(F.sum(f).alias(f) for f in fields), F.sum(visible).alias("visible_tokens"))


def pareto(totals: DataFrame, diversity: DataFrame, strata: DataFrame, by: Sequence[str], per_call: int) -> DataFrame:
    """By cell: diversity overall and by stratum, token totals, tokens a call and a text, diversity a thousand tokens.

    ``totals``: call_totals by keyword and effort; ``diversity``: keyword, effort, diversity; ``strata``: keyword, stratum.
    """
    m = totals.join(diversity, ["keyword", "effort"]).join(strata.select("keyword", "stratum").distinct(), "keyword", "left")
    generation = F.col("visible_tokens") + F.col("reasoning_tokens")
    idea_reasoning = F.col("reasoning_tokens") / F.col("n_calls") / per_call
    idea_generation = generation / F.col("n_calls") / per_call
    m = m.withColumn("generation_tokens", generation).withColumn("__r", safe_ratio(F.col("diversity") * 1000, idea_reasoning)).withColumn("__g", safe_ratio(F.col("diversity") * 1000, idea_generation))
    fields = ("input", "output", "reasoning", "visible", "generation")
    s = m.groupBy(*by).agg(
        F.count("*").alias("n_keywords"),
        F.avg("diversity").alias("diversity_mean"),
        F.avg(F.when(F.col("stratum") == "Q1", F.col("diversity"))).alias("diversity_q1_mean"),
        F.avg(F.when(F.col("stratum") == "Q4", F.col("diversity"))).alias("diversity_q4_mean"),
        F.sum("n_calls").alias("n_calls"),
        *(F.sum(f + "_tokens").alias(f + "_total") for f in fields),
        F.avg("__r").alias("diversity_per_kilo_reasoning"),
        F.avg("__g").alias("diversity_per_kilo_generation"),
    )
    return s.select("*", (F.col("n_calls") * per_call).alias("n_texts"), *((F.col(f + "_total") / F.col("n_calls")).alias(f + "_per_call") for f in fields), *((F.col(f + "_total") / F.col("n_calls") / per_call).alias(f + "_per_text") for f in fields))


def relative_gain(rows: DataFrame, by: Sequence[str], value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Gain from the low to the high tier in per cent."""
    at = {e: F.max(F.when(F.col("effort") == e, F.col(value))) for e in (low, high)}
    s = rows.groupBy(*by).agg(at[low].alias("low"), at[high].alias("high"))
    return s.withColumn("gain_percent", safe_ratio((F.col("high") - F.col("low")) * 100, F.col("low")))


def correlation_sets(rows: DataFrame, x: str, y: str, total: str = "effort") -> DataFrame:
    """Guarded Pearson by ``total`` and over all ('all')."""
    both = rows.withColumn("__g", F.explode(F.array(F.col(total), F.lit("all"))))
    return both.groupBy(F.col("__g").alias(total)).agg(F.count("*").alias("n"), guarded_corr(x, y).alias("r"))


def baseline_ratio(rows: DataFrame, value: str) -> DataFrame:
    """Median over keywords, by effort, of the ratio to the keyword's lowest tier; missing and zero baselines are left out."""
    w = Window.partitionBy("keyword").orderBy(effort_order(F.col("effort")))
    r = rows.withColumn("base", F.first(value).over(w)).where("base is not null and base <> 0").withColumn("ratio", F.col(value) / F.col("base"))
    return r.groupBy("effort").agg(F.count("*").alias("n_keywords"), F.percentile("ratio", F.lit(0.5)).alias("median_ratio"))


def attempted(samples: DataFrame, by: Sequence[str], index: str = "sample_index") -> DataFrame:
    """Samples attempted: the sum over groups of the largest index plus one."""
    return samples.groupBy(*by).agg((F.max(index) + 1).alias("n")).agg(F.sum("n").alias("n_attempted"))
