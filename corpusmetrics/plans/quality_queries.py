"""Queries on quality scores and on what they say about tiers and judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import text_key
from ..functions.constants import AXES, EFFORTS
from ..operators import judgments as J
from ..operators import quality as Q
from ..operators import selection as S
from ..operators import statistics as ST
from . import base as B
from .base import SCORES, query, r

_W = f"WITH {SCORES}"
_WIDE = ", ".join(f"avg({a}) FILTER (effort = '{e}') AS {a}_{e}" for a in AXES for e in EFFORTS)
_FULL = " AND ".join(f"{a}_{e} IS NOT NULL" for a in AXES for e in EFFORTS)
_OUT = ", ".join([f"{r(f'{a}_{e}')} AS {a}_{e}" for a in AXES for e in EFFORTS] + [f"{r(f'{a}_high - {a}_none')} AS {a}_delta" for a in AXES])


@query(f"{_W}, w AS (SELECT keyword, {_WIDE} FROM q GROUP BY keyword) SELECT keyword, {_OUT} FROM w WHERE {_FULL}")
def quality_wide_delta(spark, sf):
    return B.tidy(Q.per_keyword_wide(B.quality(spark, sf), ["keyword"], AXES, EFFORTS))


@query(f"{_W}, w AS (SELECT keyword, {_WIDE} FROM q GROUP BY keyword) " + " UNION ALL ".join(f"SELECT keyword, '{a}' AS axis, '{e}' AS effort, {r(f'{a}_{e}')} AS score FROM w WHERE {_FULL}" for a in AXES for e in EFFORTS))
def quality_long(spark, sf):
    return B.tidy(Q.wide_to_long(Q.per_keyword_wide(B.quality(spark, sf), ["keyword"], AXES, EFFORTS), ["keyword"], AXES, EFFORTS))


@query(f"{_W}, p AS (SELECT keyword, effort, {', '.join(f'avg({a}) AS {a}' for a in AXES)} FROM q GROUP BY ALL) SELECT x.effort, count(p.effort) AS n_keywords, {', '.join(f'{r(f"avg({a})")} AS {a}' for a in AXES)} FROM (VALUES ('none'), ('low'), ('medium'), ('high')) AS x(effort) LEFT JOIN p USING (effort) GROUP BY ALL")
def quality_by_effort(spark, sf):
    return B.tidy(Q.by_effort(B.quality(spark, sf), AXES))


def _joint(spark, sf):
    return Q.joint(B.quality(spark, sf), B.quality(spark, sf, 1), ["keyword", "effort", "row_idx"], AXES)


_J = f"{_W}, j AS (SELECT q.keyword, q.effort, q.row_idx, {', '.join(f'q.{a} AS {a}_a, q2.{a} AS {a}_b' for a in AXES)} FROM q JOIN q2 USING (keyword, effort, row_idx))"


@query(f"{_J} SELECT keyword, effort, count(*) AS n, {', '.join(f'{r(f"avg({a}_{s})")} AS {a}_{s}' for a in AXES for s in 'ab')} FROM j GROUP BY ALL")
def joint_subset(spark, sf):
    j = _joint(spark, sf)
    return B.tidy(j.groupBy("keyword", "effort").agg(F.count("*").alias("n"), *(F.avg(f"{a}_{s}").alias(f"{a}_{s}") for a in AXES for s in "ab")))


@query(f"{_J} SELECT x.a, y.b, count(j.row_idx) AS n, {r('100 * count(j.row_idx) / (SELECT count(*) FROM j)')} AS percent FROM generate_series(1, 10) AS x(a) CROSS JOIN generate_series(1, 10) AS y(b) LEFT JOIN j ON originality_a = a AND originality_b = b GROUP BY ALL")
def score_matrix(spark, sf):
    return B.tidy(Q.score_matrix(_joint(spark, sf), "originality_a", "originality_b", range(1, 11)))


_AXES = f"{_J}, l AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, keyword, effort, row_idx, {a}_a AS a, {a}_b AS b FROM j" for a in AXES) + ")"
_RANKED = f"{_AXES}, rr AS (SELECT *, rank() OVER (PARTITION BY axis ORDER BY a) + (count(*) OVER (PARTITION BY axis, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY axis ORDER BY b) + (count(*) OVER (PARTITION BY axis, b) - 1) / 2 AS rb FROM l)"


def _axis_rows(spark, sf):
    j = _joint(spark, sf)
    cells = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"{a}_a").alias("a"), F.col(f"{a}_b").alias("b")) for a in AXES))
    return j.select("keyword", "effort", "row_idx", F.explode(cells).alias("c")).select("keyword", "effort", "row_idx", "c.*")


@query(f"{_RANKED} SELECT axis, count(*) AS n, {r('corr(a, b)')} AS pearson, {r('corr(ra, rb)')} AS spearman, {r('avg(abs(a - b))')} AS mean_abs_diff, {r('avg(a)')} AS mean_a, {r('avg(b)')} AS mean_b FROM rr GROUP BY axis")
def axis_agreement(spark, sf):
    return B.tidy(J.axis_agreement(_axis_rows(spark, sf), "axis", "a", "b"))


@query(f"{_RANKED.replace('PARTITION BY axis', 'PARTITION BY axis, effort').replace('axis, effort, a)', 'axis, effort, a)')} SELECT axis, effort, count(*) AS n, {r('corr(a, b)')} AS pearson, {r('corr(ra, rb)')} AS spearman FROM rr GROUP BY ALL")
def quality_correlations(spark, sf):
    rows = _axis_rows(spark, sf).select("axis", "effort", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    return B.tidy(ST.correlations(rows, ["axis", "effort"], "a", "b"))


def _long(spark, sf, judge):
    t = B.table(spark, sf, "documents").select(F.col("doc_id").alias("row_idx"), F.col("lang").alias("gen"), text_key(F.col("text")).alias("text_key"))
    q = B.quality(spark, sf, judge).join(t, "row_idx")
    return Q.unpivot_axes(q, ["gen", "keyword", "effort", "text_key"]).withColumn("judge", F.lit("strong" if judge else "weak"))


def _long_sql() -> str:
    def part(t, name):
        return " UNION ALL ".join(f"SELECT d.lang AS gen, {t}.keyword, {t}.effort, substr(sha1({B.stripped("d.text")}), 1, 16) AS text_key, '{a}' AS axis, CAST({t}.{a} AS DOUBLE) AS score, '{name}' AS judge FROM {t} JOIN documents d ON d.doc_id = {t}.row_idx" for a in AXES)

    return f"{_W}, weak AS ({part('q', 'weak')}), strong AS ({part('q2', 'strong')}), lg AS (SELECT * FROM weak UNION ALL SELECT * FROM strong)"


_LONG = _long_sql()
_MEANS = f"{_LONG}, m AS (SELECT gen, judge, effort, axis, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std FROM lg GROUP BY ALL)"


def _means(spark, sf):
    return Q.condition_means(_long(spark, sf, 0).unionByName(_long(spark, sf, 1)), ["gen", "judge", "effort", "axis"])


@query(f"{_MEANS} SELECT gen, judge, effort, axis, n, {r('mean')} AS mean, {r('std')} AS std FROM m")
def condition_means(spark, sf):
    return B.tidy(_means(spark, sf))


_TREND = f"{_MEANS}, tr AS (SELECT gen, judge, axis, max(mean) FILTER (effort = 'low') AS low, max(mean) FILTER (effort = 'high') AS high FROM m GROUP BY ALL)"


@query(f"{_TREND} SELECT gen, judge, axis, {r('low')} AS low, {r('high')} AS high, {r('high - low')} AS delta, abs(high - low) < 0.5 AS flat FROM tr WHERE low IS NOT NULL AND high IS NOT NULL")
def trend_flags(spark, sf):
    return B.tidy(Q.trend(_means(spark, sf), ["gen", "judge", "axis"], "effort", "low", "high"))


_KEY = ["gen", "effort", "axis", "keyword", "text_key"]
_CAL = f"{_LONG}, cr AS (SELECT s.gen, s.effort, s.axis, s.judge AS strong, w.judge AS weak, count(*) AS n, corr(s.score, w.score) AS r FROM strong s JOIN weak w USING (gen, effort, axis, keyword, text_key) GROUP BY ALL HAVING count(*) >= 30)"


@query(f"{_CAL} SELECT gen, effort, axis, strong, weak, n, {r('CASE WHEN NOT isnan(r) THEN r END')} AS r, coalesce(CASE WHEN NOT isnan(r) THEN r END >= 0.21, FALSE) AS passes FROM cr")
def calibration_r(spark, sf):
    return B.tidy(Q.calibration_r(_long(spark, sf, 1), _long(spark, sf, 0), _KEY, ["gen", "effort", "axis"]))


@query(f"""{_CAL.replace('WITH', 'WITH', 1)}, m AS (SELECT gen, judge, effort, axis, avg(score) AS mean FROM lg GROUP BY ALL), tr AS (SELECT gen, judge, axis, max(mean) FILTER (effort = 'low') AS low, max(mean) FILTER (effort = 'high') AS high FROM m WHERE judge = 'strong' GROUP BY ALL),
t AS (SELECT coalesce(bool_and(abs(high - low) < 0.5), TRUE) AS trend_pass FROM tr WHERE low IS NOT NULL AND high IS NOT NULL), cc AS (SELECT strong, weak, avg(r) AS a, min(r) AS l FROM cr GROUP BY ALL), c AS (SELECT coalesce(bool_and(a >= 0.3 AND l >= 0.21), TRUE) AS calibration_pass FROM cc)
SELECT trend_pass, calibration_pass, CASE WHEN NOT trend_pass THEN 'C' WHEN calibration_pass THEN 'A' ELSE 'B' END AS path FROM t, c""")
def decision_rule(spark, sf):
    trends = Q.trend(_means(spark, sf).where("judge = 'strong'"), ["gen", "judge", "axis"], "effort", "low", "high")
    return Q.decide(trends, Q.calibration_r(_long(spark, sf, 1), _long(spark, sf, 0), _KEY, ["gen", "effort", "axis"]))


@query(f"{_W} SELECT keyword, effort, {r('avg((originality + feasibility + clarity) / 3)')} AS quality FROM q GROUP BY ALL")
def mean_of_axes(spark, sf):
    return B.tidy(Q.mean_of_axes(B.quality(spark, sf), ["keyword", "effort"]))


@query(f"{_W}, a AS (SELECT keyword, effort, avg((originality + feasibility + clarity) / 3) AS s FROM q GROUP BY ALL), b AS (SELECT keyword, effort, avg((originality + feasibility + clarity) / 3) AS s FROM q2 GROUP BY ALL) SELECT effort, count(*) AS n, {r('avg(abs(a.s - b.s))')} AS mean_change, {r('max(abs(a.s - b.s))')} AS largest_change FROM a JOIN b USING (keyword, effort) GROUP BY effort")
def prompt_quality_change(spark, sf):
    one, two = (Q.mean_of_axes(B.quality(spark, sf, k), ["keyword", "effort"]).withColumnRenamed("quality", "score") for k in (0, 1))
    return B.tidy(Q.change_against(one, two, ["keyword", "effort"], ["effort"]))


@query(f"{_W}, p AS (SELECT keyword, effort, avg(originality) AS m FROM q GROUP BY ALL), d AS (SELECT keyword, max(m) FILTER (effort = 'high') - max(m) FILTER (effort = 'low') AS d FROM p GROUP BY keyword) SELECT 'high-low' AS contrast, count(d) AS n, {r('avg(d)')} AS mean_diff, {r('avg(d) / nullif(stddev_samp(d), 0)')} AS d_z FROM d")
def cohens_dz(spark, sf):
    return B.tidy(ST.paired_effect(_diffs(spark, sf).withColumn("contrast", F.lit("high-low")), ["contrast"], "d"))


def _diffs(spark, sf):
    p = B.quality(spark, sf).groupBy("keyword", "effort").agg(F.avg("originality").alias("m"))
    at = {e: F.max(F.when(F.col("effort") == e, F.col("m"))) for e in ("low", "high")}
    return p.groupBy("keyword").agg((at["high"] - at["low"]).alias("d"))


_DIFF = f"{_W}, p AS (SELECT keyword, effort, avg(originality) AS m FROM q GROUP BY ALL), d AS (SELECT keyword, max(m) FILTER (effort = 'high') - max(m) FILTER (effort = 'low') AS d FROM p GROUP BY keyword)"


@query(f"{_DIFF}, x AS (SELECT d, rank() OVER (ORDER BY round(abs(d), 9)) + (count(*) OVER (PARTITION BY round(abs(d), 9)) - 1) / 2 AS r FROM d WHERE round(d, 9) <> 0) SELECT 'high-low' AS contrast, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0.0) AS w_minus FROM x")
def wilcoxon_statistic(spark, sf):
    d = _diffs(spark, sf).withColumn("d", F.round("d", 9)).withColumn("contrast", F.lit("high-low"))
    return ST.wilcoxon_statistic(d, ["contrast"], "d")


@query(f"{_W}, x AS (SELECT effort, originality, toxic, rank() OVER (PARTITION BY effort ORDER BY originality) + (count(*) OVER (PARTITION BY effort, originality) - 1) / 2 AS r FROM q) SELECT effort, count(*) FILTER (toxic = 1) AS n_first, count(*) FILTER (toxic <> 1) AS n_other, coalesce(sum(r) FILTER (toxic = 1), 0.0) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2 AS u FROM x GROUP BY effort")
def mannwhitney_u(spark, sf):
    q = B.quality(spark, sf).withColumn("side", F.col("toxic").cast("string"))
    return ST.mannwhitney_u(q, ["effort"], "originality", "side", "1")


_P = "1.0 / (1 + sum(originality) % 97)"


@query(f"{_W}, p AS (SELECT keyword, effort, {_P} AS p FROM q GROUP BY ALL), x AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS z FROM p) SELECT keyword, effort, {r('p')} AS p, {r('least(1, min(z) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))')} AS p_adjusted FROM x")
def bh_fdr(spark, sf):
    p = B.quality(spark, sf).groupBy("keyword", "effort").agg((F.lit(1.0) / (1 + F.sum("originality") % 97)).alias("p"))
    return B.tidy(ST.benjamini_hochberg(p, "p"))


@query(f"{_W} SELECT effort, {r('regr_slope(CAST(clarity AS DOUBLE), CAST(originality AS DOUBLE))')} AS slope, {r('regr_intercept(CAST(clarity AS DOUBLE), CAST(originality AS DOUBLE))')} AS intercept FROM q GROUP BY effort")
def line_fit(spark, sf):
    return B.tidy(ST.line_fit(B.quality(spark, sf), ["effort"], "originality", "clarity"))


@query("WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, n_chars FROM documents) SELECT lang, doc_id, n_chars, rank FROM d WHERE rank <= 3")
def longest_per_language(spark, sf):
    d = B.table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return B.tidy(S.top_per_group(d, ["lang"], [F.desc("n_chars"), "doc_id"], 3))


@query("WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS rn FROM documents) SELECT lang, doc_id FROM d WHERE rn <= 10")
def seeded_sample(spark, sf):
    """Ten texts a language, by a seeded hash order."""
    d = B.table(spark, sf, "documents").select("lang", "doc_id")
    return S.seeded_sample(d, ["lang"], ["doc_id"], 10, short="all")
