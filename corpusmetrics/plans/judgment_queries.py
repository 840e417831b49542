"""Queries on labels that judges gave to pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import judgments as J
from . import base as B
from .base import JUDGED, query, r

_KEY = ["keyword", "effort", "i", "j", "stratum", "rank", "order"]
_C = "count(*) AS n, " + ", ".join(f"count(*) FILTER (answer = '{x}') AS n_{x}, {r(f"count(*) FILTER (answer = '{x}') / count(*)")} AS frac_{x}" for x in "ABCD") + f", {r("count(*) FILTER (answer IN ('A', 'B')) / count(*)")} AS frac_AB, {r("count(*) FILTER (answer IN ('C', 'D')) / count(*)")} AS frac_CD"


@query(f"WITH {JUDGED} SELECT stratum, effort, {_C} FROM judged GROUP BY ALL")
def label_distribution(spark, sf):
    return B.tidy(J.label_distribution(B.judged(spark, sf), ["stratum", "effort"]))


@query(f"WITH {JUDGED} SELECT stratum, effort, rank, {_C} FROM judged GROUP BY ALL")
def rank_saturation(spark, sf):
    return B.tidy(J.label_distribution(B.judged(spark, sf), ["stratum", "effort", "rank"]))


@query(f"WITH {JUDGED} SELECT effort, stratum, {_C} FROM judged GROUP BY effort, stratum UNION ALL SELECT effort, 'all', {_C} FROM judged GROUP BY effort")
def label_grouping_sets(spark, sf):
    return B.tidy(J.label_grouping_sets(B.judged(spark, sf), ["effort"], "stratum"))


_POINTS = "CASE answer WHEN 'A' THEN 10 WHEN 'B' THEN 7 WHEN 'C' THEN 4 WHEN 'D' THEN 1 END"


@query(f"WITH {JUDGED} SELECT keyword, effort, count(*) AS n, {r(f'sum({_POINTS}) / count(*)')} AS fluency FROM judged GROUP BY ALL")
def fluency_score(spark, sf):
    return B.tidy(J.fluency(B.judged(spark, sf), ["keyword", "effort"]))


@query(f"WITH {JUDGED}, f AS (SELECT keyword, effort, sum({_POINTS}) / count(*) AS f FROM judged GROUP BY ALL), x AS (SELECT keyword, max(f) FILTER (effort = 'low') AS low, max(f) FILTER (effort = 'high') AS high FROM f GROUP BY ALL) SELECT keyword, {r('low')} AS low, {r('high')} AS high, {r('high - low')} AS lift FROM x")
def fluency_lift(spark, sf):
    return B.tidy(J.fluency_lift(J.fluency(B.judged(spark, sf), ["keyword", "effort"]), ["keyword"]))


@query(f"WITH {JUDGED} SELECT stratum, effort, answer, count(*) AS n, {r('avg(distance)')} AS mean, {r('median(distance)')} AS median, coalesce({r('stddev_samp(distance)')}, 0.0) AS std FROM judged GROUP BY ALL")
def distance_by_label(spark, sf):
    return B.tidy(J.distance_by_label(B.judged(spark, sf), ["stratum", "effort"]))


@query(f"WITH {JUDGED} SELECT stratum, effort, answer, count(*) AS n, {r('avg(distance)')} AS mean, {r('median(distance)')} AS median, coalesce({r('stddev_samp(distance)')}, 0.0) AS std, {r('quantile_cont(distance, 0.1)')} AS p10, {r('quantile_cont(distance, 0.9)')} AS p90 FROM judged GROUP BY ALL")
def facet_attribution(spark, sf):
    return B.tidy(J.attribution(B.judged(spark, sf), ["stratum", "effort"]))


@query(f"""WITH {JUDGED}, fv AS (SELECT row_idx, 'whole' AS facet, v FROM e UNION ALL SELECT row_idx, 'first half', v[:len(v) // 2] FROM e),
fu AS (SELECT *, list_transform(v, lambda x: x / CASE WHEN list_inner_product(v, v) = 0 THEN 1 ELSE sqrt(list_inner_product(v, v)) END) AS u FROM fv)
SELECT facet, answer, count(*) AS n, {r('avg(least(2, greatest(0, 1 - list_inner_product(a.u, b.u))))')} AS mean FROM judged JOIN fu a ON a.row_idx = i JOIN fu b USING (facet) WHERE b.row_idx = j GROUP BY ALL""")
def facet_lookup(spark, sf):
    """Distances of judged pairs in two facets (the whole vector, and its first half), by label."""
    s = B.samples(spark, sf).select("row_idx", "vec")
    half = F.slice("vec", F.lit(1), F.greatest(F.floor(F.size("vec") / 2).cast("int"), F.lit(1)))
    facets = s.withColumn("facet", F.lit("whole")).unionByName(s.select("row_idx", half.alias("vec"), F.lit("first half").alias("facet")))
    d = J.facet_distances(B.judged(spark, sf).select("i", "j", "answer"), facets)
    return B.tidy(d.groupBy("facet", "answer").agg(F.count("*").alias("n"), F.avg("facet_distance").alias("mean")))


_EDGES = [0.7 + 0.05 * k for k in range(11)]
_EDGES_SQL = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True))


@query(f"WITH {JUDGED}, p AS (SELECT keyword, effort, i, j, min(answer) AS answer, any_value(distance) AS distance FROM judged GROUP BY ALL) SELECT effort, {r('lo')} AS lo, {r('hi')} AS hi, {_C}, {r('avg(distance)')} AS mean_distance FROM p JOIN (VALUES {_EDGES_SQL}) AS b(lo, hi) ON distance >= lo AND distance < hi GROUP BY effort, lo, hi")
def calibration_bins(spark, sf):
    p = J.collapse_orders(B.judged(spark, sf), ["keyword", "effort", "i", "j"])
    return B.tidy(J.calibration(p, ["effort"], _EDGES))


@query(f"WITH {JUDGED}, p AS (SELECT keyword, effort, i, j, any_value(distance) AS distance FROM judged GROUP BY ALL) SELECT count(*) FILTER (distance >= 0.7) AS n_beyond FROM p")
def calibration_overflow(spark, sf):
    return J.beyond_bins(J.collapse_orders(B.judged(spark, sf), ["keyword", "effort", "i", "j"]))


_L = "(ascii({}) - 65)"
_GAP = f"abs({_L.format('a')} - {_L.format('b')})"
_BOTH = JUDGED + """, o AS (SELECT x.keyword, x.effort, x.i, x.j, x.stratum, x.rank, x.answer AS a, y.answer AS b FROM judged x JOIN judged y USING (keyword, effort, i, j, stratum, rank) WHERE x."order" = 'ab' AND y."order" = 'ba')"""
_TWO = JUDGED + """, o AS (SELECT x.keyword, x.effort, x.i, x.j, x.stratum, x.rank, x."order", x.answer AS a, y.answer AS b FROM judged x JOIN judged2 y USING (keyword, effort, i, j, stratum, rank, "order"))"""


@query(f"WITH {_BOTH} SELECT stratum, effort, count(*) AS n, count(*) FILTER ({_GAP} = 0) AS n_exact, count(*) FILTER ({_GAP} = 1) AS n_adjacent, count(*) FILTER ({_GAP} > 1) AS n_far, {r(f'count(*) FILTER ({_GAP} = 0) / count(*)')} AS consistency FROM o GROUP BY ALL")
def position_consistency(spark, sf):
    return B.tidy(J.consistency(J.both_orders(B.judged(spark, sf), ["keyword", "effort", "i", "j", "stratum", "rank"]), ["stratum", "effort"]))


def _two(spark, sf):
    p = B.stratified(spark, sf)
    a = B.judged(spark, sf, pairs=p).withColumnRenamed("answer", "a").drop("distance")
    b = B.judged(spark, sf, 1, p).withColumnRenamed("answer", "b").drop("distance")
    return C.unique(a, _KEY).join(C.unique(b, _KEY), _KEY)


@query(f"WITH {_TWO} SELECT x.a, y.b, count(o.a) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D')) AS x(a) CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D')) AS y(b) LEFT JOIN o ON o.a = x.a AND o.b = y.b GROUP BY ALL")
def confusion_matrix(spark, sf):
    return J.confusion(_two(spark, sf), "a", "b")


def _kappa(by: str) -> str:
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    return f"""
na AS (SELECT {g}a, count(*) AS c FROM o GROUP BY {g}a), nb AS (SELECT {g}b, count(*) AS c FROM o GROUP BY {g}b),
ex AS (SELECT {g}sum(na.c * nb.c * power({_L.format('a')} - {_L.format('b')}, 2)) AS e, sum(CASE WHEN a = b THEN na.c * nb.c ELSE 0 END) AS ch FROM na JOIN nb {on} {f'GROUP BY {by}' if by else ''}),
ob AS (SELECT {g}count(*) AS n, sum(power({_L.format('a')} - {_L.format('b')}, 2)) AS o, avg(CAST(a = b AS INT)) AS agreement FROM o {f'GROUP BY {by}' if by else ''}),
kp AS (SELECT ob.*, CASE WHEN ch / (n * n) < 1 THEN (agreement - ch / (n * n)) / (1 - ch / (n * n)) END AS kappa, CASE WHEN abs(e / n) > 1e-9 THEN 1 - o / (e / n) END AS weighted_kappa FROM ob JOIN ex {on})"""


_KCOLS = f"n, {r('agreement')} AS agreement, {r('kappa')} AS kappa, {r('weighted_kappa')} AS weighted_kappa"


@query(f"WITH {_TWO}, {_kappa('stratum')} SELECT stratum, {_KCOLS} FROM kp")
def weighted_kappa(spark, sf):
    return B.tidy(J.kappa(_two(spark, sf), ["stratum"], "a", "b"))


@query(f"WITH {_TWO}, {_kappa('')} SELECT 'all' AS scope, {_KCOLS} FROM kp")
def kappa_overall(spark, sf):
    return B.tidy(J.kappa(_two(spark, sf), [], "a", "b").select(F.lit("all").alias("scope"), "*"))


@query(f"WITH {_TWO.replace('o AS (', 'oo AS (')}, o AS (SELECT * FROM oo WHERE effort <> 'none'), {_kappa('')} SELECT 'analysed' AS scope, {_KCOLS} FROM kp")
def kappa_analysed_tiers(spark, sf):
    return B.tidy(J.kappa(_two(spark, sf).where(F.col("effort").isin("low", "medium", "high")), [], "a", "b").select(F.lit("analysed").alias("scope"), "*"))


@query(f"""WITH {JUDGED}, f AS (SELECT keyword, effort, avg(CAST(answer = 'A' AS INT)) AS f FROM judged WHERE stratum = 'top' GROUP BY ALL)
SELECT keyword, {', '.join(f"{r(f"max(f) FILTER (effort = '{x}')")} AS \"{x}\"" for x in ('none', 'low', 'medium', 'high'))} FROM f GROUP BY keyword""")
def frac_a_pivot(spark, sf):
    f = B.judged(spark, sf).where("stratum = 'top'").groupBy("keyword", "effort").agg(F.avg((F.col("answer") == "A").cast("double")).alias("f"))
    return B.tidy(f.groupBy("keyword").pivot("effort", ["none", "low", "medium", "high"]).agg(F.first("f")))


@query(f"WITH {JUDGED}, {B.TOKENS}, tk AS (SELECT CAST(CAST(keyword AS BIGINT) % 10 AS VARCHAR) AS keyword, effort, visible + reasoning_tokens AS g FROM k), a AS (SELECT keyword, effort, avg(g) AS m, median(g) AS md FROM tk GROUP BY ALL), d AS (SELECT keyword, effort, avg(distance) AS d FROM pairs GROUP BY ALL), s AS (SELECT keyword, effort, avg(CAST(answer = 'A' AS INT)) FILTER (stratum = 'top') AS ft, avg(CAST(answer = 'A' AS INT)) AS f FROM judged GROUP BY ALL) SELECT a.keyword, a.effort, {r('m')} AS mean_tokens, {r('md')} AS median_tokens, {r('d')} AS mean_distance, {r('ft')} AS frac_A_top, {r('f')} AS frac_A FROM a LEFT JOIN d USING (keyword, effort) LEFT JOIN s USING (keyword, effort)")
def compute_curve(spark, sf):
    from ..operators import diversity as D

    k = B.token_rows(spark, sf).select((F.col("keyword").cast("long") % 10).cast("string").alias("keyword"), "effort", (F.col("visible") + F.col("reasoning_tokens")).alias("generation_tokens"))
    d = D.mean_pairwise_distance(B.samples(spark, sf), small=None)
    return B.tidy(J.compute_curve(k, d, B.judged(spark, sf)))


@query(f"WITH {JUDGED}, a AS (SELECT keyword, effort, i, j, stratum FROM judged WHERE answer = 'A') SELECT keyword, effort, i, j, \"order\", count(*) AS n FROM judged GROUP BY ALL HAVING count(*) > 1")
def judgment_duplicate_keys(spark, sf):
    return C.duplicate_keys(B.judged(spark, sf), ["keyword", "effort", "i", "j", "order"])
