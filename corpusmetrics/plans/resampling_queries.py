"""Intervals, tests and kernels by group.  Draws are counter-based hashes, so SQL takes the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import AXES
from ..operators import diversity as D
from ..operators import neighbours as N
from ..operators import quality as Q
from ..operators import resampling as R
from ..operators import selection as S
from ..operators import spectra as SP
from ..operators import statistics as ST
from . import base as B
from .base import PAIRS, SCORES, query, r
from .vector_queries import NEAR


@query()
def vendi_score(spark, sf):
    return SP.vendi_scores(B.samples(spark, sf), ["keyword", "effort"])


@query()
def pca_2d(spark, sf):
    return SP.pca_coordinates(B.samples(spark, sf), ["keyword"])


def _means(spark, sf):
    return D.mean_pairwise_distance(B.samples(spark, sf), small=None).select("keyword", "effort", F.col("mean_distance").alias("value"))


_MEANS = f"{PAIRS}, m AS MATERIALIZED (SELECT keyword, effort, avg(distance) AS value FROM pairs GROUP BY ALL)"


@query(f"WITH {_MEANS}{B.boot_mean('m', ['effort'], 'value')}")
def bootstrap_mean_ci(spark, sf):
    return B.tidy(R.bootstrap_mean_ci(_means(spark, sf), ["effort"], "value"))


_SIDES = f"""{_MEANS}, pool AS MATERIALIZED (SELECT effort, value, CASE WHEN rn <= n // 4 THEN 'Q1' ELSE 'Q4' END AS stratum
    FROM (SELECT *, row_number() OVER (PARTITION BY effort ORDER BY value, keyword) AS rn, count(*) OVER (PARTITION BY effort) AS n FROM m) WHERE rn <= n // 4 OR rn > n - n // 4),
{B.drawn("(SELECT * FROM pool WHERE stratum = 'Q1')", ["effort"], "value", 10_000, 42, "d0")}, {B.drawn("(SELECT * FROM pool WHERE stratum = 'Q4')", ["effort"], "value", 10_000, 43, "d1")},
b AS (SELECT effort, draw, x.m / y.m AS q FROM (SELECT effort, draw, avg(value) AS m FROM d0 GROUP BY ALL) x JOIN (SELECT effort, draw, avg(value) AS m FROM d1 GROUP BY ALL) y USING (effort, draw) WHERE abs(y.m) >= 1e-9)"""


@query(f"WITH {_SIDES} SELECT effort, {r('any_value(ratio)')} AS ratio, {r('quantile_cont(q, 0.025)')} AS ci_low, {r('quantile_cont(q, 0.975)')} AS ci_high FROM b JOIN (SELECT effort, avg(value) FILTER (stratum = 'Q1') / avg(value) FILTER (stratum = 'Q4') AS ratio FROM pool GROUP BY effort) USING (effort) GROUP BY effort")
def bootstrap_ratio_ci(spark, sf):
    q = S.quartile_pools(_means(spark, sf), ["effort"], "value", "keyword")
    return B.tidy(R.bootstrap_ratio_ci(q, ["effort"], "value", "stratum", "Q1", "Q4", n_boot=10_000))


def _scores(spark, sf):
    q = B.quality(spark, sf)
    return q.select("effort", *(F.col(a).cast("double").alias(a) for a in AXES))


@query(f"WITH {SCORES}{B.boot_pearson('q', ['effort'], 'originality', 'clarity')}")
def bootstrap_pearson_ci(spark, sf):
    return B.tidy(R.bootstrap_pearson_ci(_scores(spark, sf), ["effort"], "originality", "clarity"))


_LOG = f"""{PAIRS.replace('e AS (', 'e AS MATERIALIZED (', 1)}, {B.TOKENS}, g AS (SELECT keyword, effort, median(generation) AS tokens FROM (SELECT CAST(CAST(keyword AS BIGINT) % 10 AS VARCHAR) AS keyword, effort, total_tokens - input_tokens AS generation FROM k) GROUP BY ALL),
cells AS MATERIALIZED (SELECT effort, tokens, round(distance, 9) AS distance FROM (SELECT keyword, effort, avg(distance) AS distance FROM pairs GROUP BY ALL) JOIN g USING (keyword, effort))"""


@query(f"WITH {_LOG}{B.boot_pearson('cells', ['effort'], 'tokens', 'distance', 10_000)}")
def tokens_distance_within_effort(spark, sf):
    """Within a tier, whether keywords whose answers take more tokens have texts further apart, with its interval."""
    k = B.token_rows(spark, sf)
    tokens = k.groupBy((F.col("keyword").cast("long") % 10).cast("string").alias("keyword"), "effort").agg(F.percentile(F.col("total_tokens") - F.col("input_tokens"), F.lit(0.5)).alias("tokens"))
    cells = _means(spark, sf).withColumn("distance", F.round("value", 9)).join(tokens, ["keyword", "effort"])
    return B.tidy(R.bootstrap_pearson_ci(cells, ["effort"], "tokens", "distance", n_boot=10_000))


#: Facets of a sample: its vector, and the two halves of it.
_FACET_VECTORS = {"combined": "v", "first_half": "v[:len(v) // 2]", "second_half": "v[len(v) // 2 + 1:]"}
_FACETS = f"""{B.EMB}, fv AS (SELECT *, sqrt(list_inner_product(f, f)) AS size FROM ({' UNION ALL '.join(f"SELECT keyword, effort, row_idx, '{n}' AS facet, {x} AS f FROM e" for n, x in _FACET_VECTORS.items())})),
fu AS MATERIALIZED (SELECT keyword, effort, facet, row_idx, list_transform(f, lambda x: x / CASE WHEN size = 0 THEN 1 ELSE size END) AS u FROM fv),
fm AS MATERIALIZED (SELECT facet, effort, a.keyword, round(avg(1 - list_inner_product(a.u, b.u)), 9) AS value FROM fu a JOIN fu b USING (facet, effort) WHERE a.keyword = b.keyword AND a.row_idx < b.row_idx GROUP BY ALL)"""


def _facet_means(spark, sf):
    s = B.samples(spark, sf)
    half = F.floor(F.size("vec") / 2).cast("int")
    parts = {"combined": F.col("vec"), "first_half": F.slice("vec", F.lit(1), half), "second_half": F.slice("vec", half + 1, F.size("vec") - half)}
    rows = s.select("keyword", "effort", "row_idx", F.explode(F.array(*(F.struct(F.lit(n).alias("facet"), v.alias("vec")) for n, v in parts.items()))).alias("f")).select("keyword", "effort", "row_idx", "f.*")
    m = D.mean_pairwise_distance(rows, ["facet", "effort", "keyword"], small=None)
    return m.where("mean_distance IS NOT NULL").select("facet", "effort", "keyword", F.round("mean_distance", 9).alias("value"))


_POOLS = """,
base AS (SELECT keyword, row_number() OVER (ORDER BY value, keyword) AS rn, count(*) OVER () AS n FROM fm WHERE facet = 'combined' AND effort = 'low'),
fs AS MATERIALIZED (SELECT fm.*, CASE WHEN rn <= n // 4 THEN 'Q1' ELSE 'Q4' END AS stratum FROM fm JOIN base USING (keyword) WHERE rn <= n // 4 OR rn > n - n // 4)"""


@query(f"WITH {_FACETS}{_POOLS}{B.boot_mean('fs', ['facet', 'effort', 'stratum'], 'value')}")
def facet_distance_by_stratum(spark, sf):
    """Mean over keywords of the mean distance, by facet, tier and stratum, with its interval; strata are the lowest and highest quarter of keywords at the low tier."""
    means = _facet_means(spark, sf)
    base = means.where("facet = 'combined' AND effort = 'low'").withColumn("all", F.lit(1))
    pools = S.quartile_pools(base, ["all"], "value", "keyword").select("keyword", "stratum")
    return B.tidy(R.bootstrap_mean_ci(means.join(pools, "keyword"), ["facet", "effort", "stratum"], "value"))


@query(f"WITH {_FACETS} SELECT facet, effort, count(*) AS n_keywords, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std FROM fm GROUP BY ALL")
def facet_diversity(spark, sf):
    """By facet and tier: mean and population deviation over keywords of their mean distance."""
    return B.tidy(_facet_means(spark, sf).groupBy("facet", "effort").agg(F.count("*").alias("n_keywords"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


@query()
def perm_spearman(spark, sf):
    return R.perm_spearman(_scores(spark, sf), ["effort"], "originality", "clarity")


@query(f"WITH {SCORES}, ka AS MATERIALIZED ({' UNION ALL '.join(f"SELECT keyword, effort, '{a}' AS axis, avg({a}) AS score FROM q GROUP BY ALL" for a in AXES)}){B.boot_mean('ka', ['effort', 'axis'], 'score')}")
def quality_by_effort_ci(spark, sf):
    per = B.quality(spark, sf).groupBy("keyword", "effort").agg(*(F.avg(a).alias(a) for a in AXES))
    return B.tidy(R.bootstrap_mean_ci(Q.unpivot_axes(per, ["keyword", "effort"]), ["effort", "axis"], "score"))


@query(f"""WITH {NEAR}, x AS (SELECT keyword, i, k, avg(CAST(gi = gj AS INT)) AS s FROM nr, (VALUES (1), (3), (5), (10)) AS ks(k) WHERE rank <= k GROUP BY ALL),
pk AS MATERIALIZED (SELECT CAST(k AS BIGINT) AS k, round(avg(s), 12) AS purity FROM x GROUP BY keyword, k){B.boot_mean('pk', ['k'], 'purity', 10_000)}""")
def purity_with_ci(spark, sf):
    near = N.soft_purity(N.neighbours(B.samples(spark, sf), ["keyword"], "gen", 10), ["keyword"], [1, 3, 5, 10])
    return B.tidy(R.bootstrap_mean_ci(near.withColumn("purity", F.round("purity", 12)), ["k"], "purity", n_boot=10_000))


_CROSS = f"""{B.EMB}, cw AS (SELECT a.keyword, a.gen AS ga, b.gen AS gb, a.row_idx AS i, b.row_idx AS j, 1 - list_inner_product(a.u, b.u) AS d FROM e a JOIN e b ON a.keyword = b.keyword),
wi AS (SELECT keyword, ga AS gen, avg(d) AS w FROM cw WHERE ga = gb AND i <> j GROUP BY ALL), cr AS (SELECT keyword, ga, gb, avg(d) AS c FROM cw WHERE ga < gb GROUP BY ALL),
ratios AS MATERIALIZED (SELECT ga AS gen_a, gb AS gen_b, round(c / nullif((x.w + y.w) / 2, 0), 9) AS ratio FROM cr LEFT JOIN wi x ON x.keyword = cr.keyword AND x.gen = ga LEFT JOIN wi y ON y.keyword = cr.keyword AND y.gen = gb)"""


@query(f"WITH {_CROSS}{B.boot_mean('ratios', ['gen_a', 'gen_b'], 'ratio', 10_000)}")
def cross_within_ci(spark, sf):
    c = D.cross_within(B.samples(spark, sf), "keyword", "gen").withColumn("ratio", F.round("cross_within_ratio", 9))
    return B.tidy(R.bootstrap_mean_ci(c, ["gen_a", "gen_b"], "ratio", n_boot=10_000))


def _gains(spark, sf):
    return D.low_high_change(_means(spark, sf), ["keyword"], "value").select("keyword", "change").withColumn("contrast", F.lit("high-low"))


@query()
def rank_test_pvalues(spark, sf):
    g = _gains(spark, sf)
    w = ST.wilcoxon_test(g, ["contrast"], "change").select("contrast", F.lit("wilcoxon").alias("test"), F.col("w_plus").alias("statistic"), "p")
    q = _scores(spark, sf).join(B.quality(spark, sf).select("effort").distinct(), "effort").withColumn("side", F.when(F.col("feasibility") > 5, "upper").otherwise("lower"))
    m = ST.mannwhitney_test(q, ["effort"], "originality", "side", "upper").select(F.col("effort").alias("contrast"), F.lit("mannwhitney").alias("test"), F.col("u").alias("statistic"), "p")
    return ST.benjamini_hochberg(w.unionByName(m), "p")
