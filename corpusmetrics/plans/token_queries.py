"""Queries on token cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import json_long, total_tokens, visible_tokens
from ..operators import diversity as D
from ..operators import selection as S
from ..operators import tokens as T
from . import base as B
from .base import TOKENS, query, r

_W = f"WITH {TOKENS}"


@query(f"{_W} SELECT prompt, effort, count(value) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('min(value)')} AS least, {r('max(value)')} AS most, " + ", ".join(f"{r(f'quantile_cont(value, {q})')} AS p{round(100 * q)}" for q in T.QUANTILES) + " FROM k GROUP BY ALL")
def token_usage_quantiles(spark, sf):
    return B.tidy(T.usage(B.token_rows(spark, sf), ["prompt", "effort"], "value"))


def _totals(spark, sf):
    return T.call_totals(T.calls(B.token_rows(spark, sf), ["keyword", "effort"], 3), ["keyword", "effort"])


_CALLS = f"{_W}, cl AS (SELECT *, sample_index // 3 AS call, row_number() OVER (PARTITION BY keyword, effort, sample_index // 3 ORDER BY sample_index) AS rn FROM k), ct AS (SELECT keyword, effort, count(*) AS n_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(sum(total_tokens - input_tokens - reasoning_tokens) AS BIGINT) AS visible_tokens FROM cl WHERE rn = 1 GROUP BY ALL)"


@query(f"{_CALLS} SELECT * FROM ct")
def call_dedup_tokens(spark, sf):
    return _totals(spark, sf)


def _diversity(spark, sf):
    d = D.mean_pairwise_distance(B.samples(spark, sf), small=None).withColumn("diversity", F.round("mean_distance", 9))
    return d.select("keyword", "effort", "diversity")


def _strata(spark, sf):
    d = _diversity(spark, sf).where("effort = 'low'")
    return S.quartile_pools(d, ["effort"], "diversity", "keyword").select("keyword", "stratum")


_PARETO = (
    f"WITH {B.PAIRS}, {_CALLS[5:]}"
    + """,
dv AS (SELECT keyword, effort, round(avg(distance), 9) AS diversity FROM pairs GROUP BY ALL),
sq AS (SELECT keyword, row_number() OVER (ORDER BY diversity, keyword) AS rn, count(*) OVER () AS n FROM dv WHERE effort = 'low'),
sa AS (SELECT keyword, CASE WHEN rn <= n // 4 THEN 'Q1' ELSE 'Q4' END AS stratum FROM sq WHERE rn <= n // 4 OR rn > n - n // 4),
mg AS (SELECT ct.*, dv.diversity, sa.stratum, visible_tokens + reasoning_tokens AS generation_tokens FROM ct JOIN dv USING (keyword, effort) LEFT JOIN sa USING (keyword))"""
)
_FIELDS = ("input", "output", "reasoning", "visible", "generation")


@query(
    f"{_PARETO} SELECT effort, count(*) AS n_keywords, {r('avg(diversity)')} AS diversity_mean, {r("avg(diversity) FILTER (stratum = 'Q1')")} AS diversity_q1_mean, {r("avg(diversity) FILTER (stratum = 'Q4')")} AS diversity_q4_mean, CAST(sum(n_calls) AS BIGINT) AS n_calls, CAST(sum(n_calls) * 3 AS BIGINT) AS n_texts, "
    + ", ".join(f"CAST(sum({f}_tokens) AS BIGINT) AS {f}_total, {r(f'sum({f}_tokens) / sum(n_calls)')} AS {f}_per_call, {r(f'sum({f}_tokens) / sum(n_calls) / 3')} AS {f}_per_text" for f in _FIELDS)
    + f", {r('avg(diversity * 1000 / nullif(reasoning_tokens / n_calls / 3, 0))')} AS diversity_per_kilo_reasoning, {r('avg(diversity * 1000 / nullif(generation_tokens / n_calls / 3, 0))')} AS diversity_per_kilo_generation FROM mg GROUP BY effort"
)
def pareto_cells(spark, sf):
    return B.tidy(T.pareto(_totals(spark, sf), _diversity(spark, sf), _strata(spark, sf), ["effort"], 3))


@query(f"{_W}, m AS (SELECT prompt, effort, avg(value) AS v FROM k GROUP BY ALL), x AS (SELECT prompt, max(v) FILTER (effort = 'low') AS low, max(v) FILTER (effort = 'high') AS high FROM m GROUP BY prompt) SELECT prompt, {r('low')} AS low, {r('high')} AS high, {r('100 * (high - low) / nullif(low, 0)')} AS gain_percent FROM x")
def effort_gain(spark, sf):
    m = B.token_rows(spark, sf).groupBy("prompt", "effort").agg(F.avg("value").alias("v"))
    return B.tidy(T.relative_gain(m, ["prompt"], "v"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS reasoning_tokens, coalesce(CAST(json_extract_string(props, '$.absent') AS BIGINT), 0) AS thought_tokens FROM events")
def json_reasoning_tokens(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", json_long(F.col("props"), "$.k").alias("reasoning_tokens"), json_long(F.col("props"), "$.absent", 0).alias("thought_tokens"))


@query(f"{_W} SELECT sample_index, total_tokens - input_tokens - reasoning_tokens AS visible_tokens, CAST(input_tokens + output_tokens AS DOUBLE) AS total_tokens FROM k")
def derived_tokens(spark, sf):
    k = B.token_rows(spark, sf)
    return k.select("sample_index", visible_tokens(F.col("total_tokens"), F.col("input_tokens"), F.col("reasoning_tokens")).alias("visible_tokens"), total_tokens(F.lit(None).cast("string"), F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string")).alias("total_tokens"))


@query(f"{_W}, m AS (SELECT keyword, effort, median(reasoning_tokens) AS x, avg(value) AS y FROM k GROUP BY ALL) SELECT effort, count(*) AS n, {r('corr(x, y)')} AS r FROM m GROUP BY effort UNION ALL SELECT 'all', count(*), {r('corr(x, y)')} FROM m")
def token_diversity_corr(spark, sf):
    m = B.token_rows(spark, sf).groupBy("keyword", "effort").agg(F.percentile("reasoning_tokens", F.lit(0.5)).alias("x"), F.avg("value").alias("y"))
    return B.tidy(T.correlation_sets(m, "x", "y"))


@query(f"{_W}, m AS (SELECT keyword, effort, avg(value) AS v FROM k GROUP BY ALL), b AS (SELECT *, first_value(v) OVER (PARTITION BY keyword ORDER BY list_position(['none', 'low', 'medium', 'high'], effort)) AS base FROM m) SELECT effort, count(*) AS n_keywords, {r('median(v / base)')} AS median_ratio FROM b WHERE base IS NOT NULL AND base <> 0 GROUP BY effort")
def baseline_ratio(spark, sf):
    m = B.token_rows(spark, sf).groupBy("keyword", "effort").agg(F.avg("value").alias("v"))
    return B.tidy(T.baseline_ratio(m, "v"))


@query(f"{_W}, m AS (SELECT keyword, effort, median(reasoning_tokens) AS x, avg(value) AS y FROM k GROUP BY ALL), a AS (SELECT effort, median(x) AS median_tokens, avg(y) AS mean_value FROM m GROUP BY effort) SELECT effort, {r('median_tokens')} AS median_tokens, {r('mean_value')} AS mean_value FROM a")
def two_level_medians(spark, sf):
    m = B.token_rows(spark, sf).groupBy("keyword", "effort").agg(F.percentile("reasoning_tokens", F.lit(0.5)).alias("x"), F.avg("value").alias("y"))
    return B.tidy(m.groupBy("effort").agg(F.percentile("x", F.lit(0.5)).alias("median_tokens"), F.avg("y").alias("mean_value")))


@query(f"{_W}, m AS (SELECT keyword, effort, avg(value) AS v FROM k GROUP BY ALL), x AS (SELECT keyword, max(v) FILTER (effort = 'none') AS n, max(v) FILTER (effort = 'low') AS l, max(v) FILTER (effort = 'medium') AS m, max(v) FILTER (effort = 'high') AS h FROM m GROUP BY keyword) SELECT count(*) FILTER (m > n) AS n_medium_above_none, count(*) FILTER (h > n) AS n_high_above_none, count(*) FILTER (l < n) AS n_low_below_none FROM x")
def sign_counts(spark, sf):
    m = B.token_rows(spark, sf).groupBy("keyword", "effort").agg(F.avg("value").alias("v"))
    p = m.groupBy("keyword").pivot("effort", ["none", "low", "medium", "high"]).agg(F.first("v"))
    return p.agg(F.count_if(F.col("medium") > F.col("none")).alias("n_medium_above_none"), F.count_if(F.col("high") > F.col("none")).alias("n_high_above_none"), F.count_if(F.col("low") < F.col("none")).alias("n_low_below_none"))
