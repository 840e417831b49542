"""Queries on contrasts of cells: a cell is a prompt kind (by id % 3) and a tier, with one value for each keyword."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import AXES, CELL_CONTRASTS, EFFECT_COMPARISONS, GAIN_CONTRASTS, QUALITY_CONTRASTS
from ..operators import contrasts as X
from ..operators import diversity as D
from ..operators import judgments as J
from ..operators import resampling as R
from ..operators import spectra as SP
from ..operators import statistics as ST
from . import base as B
from .base import EMB, JUDGED, SCORES, query, r
from .judgment_queries import _KEY, _TWO, _kappa, _two  # noqa: F401

KINDS = ("default", "vs", "ssot")


def _kind(c):
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(c, F.lit(3)) + 1).cast("int"))


def _samples(spark, sf):
    return B.samples(spark, sf).withColumn("kind", _kind(F.col("row_idx")))


def _cells(spark, sf):
    """Mean distance of the pairs of every keyword, kind and tier."""
    return D.mean_pairwise_distance(_samples(spark, sf), ["keyword", "kind", "effort"], small=None).select("keyword", "kind", "effort", F.col("mean_distance").alias("value"))


#: Keywords drawn of each quarter; the tables have ten keywords, so their quarters hold two.
PER_STRATUM = 2


def _strata(cells):
    return X.quartile_strata(cells, "value", PER_STRATUM, short="all")


def _scores(spark, sf, judge=0):
    q = B.quality(spark, sf, judge).withColumn("kind", _kind(F.col("row_idx")))
    return q.groupBy("keyword", "kind", "effort").agg(*(F.avg(a).alias(a) for a in AXES))


def _values(contrasts) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in (X.label(c), *c)) + ")" for c in contrasts)


_K = "['default', 'vs', 'ssot'][{} % 3 + 1]"


def _pools(cells: str, where: str = "") -> str:
    """Table st: the quartile pools of a table of base values, and the draw."""
    return f"""st0 AS (SELECT keyword, row_number() OVER (ORDER BY round(value, 9), keyword) AS rn, count(*) OVER () AS n FROM {cells} {where}),
st1 AS (SELECT keyword, CASE WHEN rn <= n // 4 THEN 'Q1' ELSE 'Q4' END AS stratum FROM st0 WHERE rn <= n // 4 OR rn > n - n // 4),
st AS MATERIALIZED (SELECT keyword, stratum FROM st1 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(keyword || ':42'), keyword) <= {PER_STRATUM})"""


_CELLS = f"""{EMB}, ek AS (SELECT *, {_K.format('row_idx')} AS kind FROM e),
p AS (SELECT a.keyword, a.kind, a.effort, avg(1 - list_inner_product(a.u, b.u)) AS value FROM ek a JOIN ek b ON a.keyword = b.keyword AND a.kind = b.kind AND a.effort = b.effort AND a.row_idx < b.row_idx GROUP BY ALL),
{_pools('p', "WHERE kind = 'default' AND effort = 'low'")}"""
_MEANS = ", ".join(f"count(*) FILTER (stratum = '{s}') AS n_{s.lower()}" for s in X.STRATA)


def _gain_cols(values) -> str:
    out = []
    for v in values:
        q1, q4 = (f"avg({v}) FILTER (stratum = '{s}')" for s in X.STRATA)
        out += [f"{r(q1)} AS {v}_q1", f"{r(q4)} AS {v}_q4", f"{r(f'CASE WHEN abs({q4}) >= 1e-9 THEN {q1} / {q4} END', 4)} AS {v}_ratio"]
    return ", ".join(out)


def _ratios(df):
    return df.select(*(B.rounded(F.col(c), 4).alias(c) if c.endswith("_ratio") else F.col(c) for c in df.columns))


@query(f"""WITH {_CELLS}, ct(contrast, lk, le, rk, re) AS (VALUES {_values(GAIN_CONTRASTS)}),
g AS (SELECT contrast, l.keyword, stratum, l.value - x.value AS abs_gain, (l.value - x.value) / nullif(x.value, 0) AS rel_gain FROM ct JOIN p l ON l.kind = lk AND l.effort = le JOIN p x ON x.kind = rk AND x.effort = re AND x.keyword = l.keyword JOIN st ON st.keyword = l.keyword)
SELECT ct.contrast, CASE WHEN NOT EXISTS (FROM p WHERE kind = lk AND effort = le) OR NOT EXISTS (FROM p WHERE kind = rk AND effort = re) THEN 'missing cell' END AS skipped, m.* EXCLUDE (contrast)
FROM ct LEFT JOIN (SELECT contrast, {_MEANS}, {_gain_cols(('abs_gain', 'rel_gain'))} FROM g WHERE rel_gain IS NOT NULL GROUP BY contrast) m ON m.contrast = ct.contrast""")
def gain_table(spark, sf):
    c = _cells(spark, sf)
    return B.tidy(X.with_skipped(_ratios(X.gain_means(X.gains(c, _strata(c), GAIN_CONTRASTS))), c.where("value IS NOT NULL"), GAIN_CONTRASTS))


@query()
def gain_table_tests(spark, sf):
    c = _cells(spark, sf)
    return X.gain_tests(X.gains(c, _strata(c), GAIN_CONTRASTS))


_QC = f"""{_CELLS}, {SCORES}, qc AS (SELECT keyword, {_K.format('row_idx')} AS kind, effort, {', '.join(f'avg({a}) AS {a}' for a in AXES)} FROM q GROUP BY ALL),
sq AS (SELECT 'baseline-quality' AS strata, keyword, CASE WHEN row_number() OVER (ORDER BY round(({' + '.join(AXES)}) / 3, 9), keyword) <= count(*) OVER () // 2 THEN 'Q1' ELSE 'Q4' END AS stratum FROM qc WHERE kind = 'default' AND effort = 'low'
       UNION ALL SELECT 'pair-distance', 'src' || keyword, stratum FROM st)"""


def _quality_deltas(spark, sf):
    """Deltas under either strata: halves by baseline quality, and quarters by baseline distance (of the label that a source's number names)."""
    c = _scores(spark, sf)
    far = _strata(_cells(spark, sf)).withColumn("keyword", F.concat(F.lit("src"), "keyword"))
    both = {"baseline-quality": X.baseline_strata(c, AXES), "pair-distance": far}
    by, by_far = (X.quality_deltas(c, s, QUALITY_CONTRASTS, AXES).withColumn("strata", F.lit(n)) for n, s in both.items())
    return by.unionByName(by_far)


@query(f"""WITH {_QC}, ct(contrast, lk, le, rk, re) AS (VALUES {_values(QUALITY_CONTRASTS)}),
d AS (SELECT strata, contrast, stratum, {', '.join(f'l.{a} - x.{a} AS {a}' for a in AXES)} FROM ct JOIN qc l ON l.kind = lk AND l.effort = le JOIN qc x ON x.kind = rk AND x.effort = re AND x.keyword = l.keyword JOIN sq ON sq.keyword = l.keyword),
ax AS ({' UNION ALL '.join([f"SELECT strata, contrast, stratum, '{a}' AS axis, {a} AS delta FROM d" for a in AXES] + [f"SELECT strata, contrast, stratum, 'avg', ({' + '.join(AXES)}) / 3 FROM d"])})
SELECT strata, contrast, axis, {_MEANS}, {_gain_cols(('delta',))} FROM ax GROUP BY ALL""")
def quality_delta_table(spark, sf):
    return B.tidy(_ratios(X.gain_means(_quality_deltas(spark, sf), ["strata", "contrast", "axis"], ["delta"])))


@query()
def quality_delta_tests(spark, sf):
    return X.gain_tests(_quality_deltas(spark, sf), ["strata", "contrast", "axis"], ["delta"], zeros="zsplit", least=2, family=["strata"])


_FRAC = "f AS (SELECT keyword, effort, avg(CAST(answer = 'A' AS INT)) AS f FROM judged WHERE stratum = 'top' GROUP BY ALL)"


def _frac_a(spark, sf):
    top = B.judged(spark, sf).where("stratum = 'top'")
    return top.groupBy("keyword", "effort").agg(F.avg((F.col("answer") == "A").cast("double")).alias("value"))


@query(f"""WITH {JUDGED}, {_FRAC}, cp(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in EFFECT_COMPARISONS)})
SELECT cp.a || '_vs_' || cp.b AS comparison, count(*) AS n_keywords, {r('avg(x.f)')} AS mean_baseline, {r('avg(y.f)')} AS mean_treatment, {r('avg(y.f - x.f)')} AS mean_diff, {r('avg(y.f - x.f) / nullif(stddev_samp(y.f - x.f), 0)')} AS cohens_dz
FROM cp JOIN f x ON x.effort = cp.a JOIN f y ON y.effort = cp.b AND y.keyword = x.keyword GROUP BY ALL HAVING count(*) >= 2""")
def effort_effects(spark, sf):
    return B.tidy(X.paired_effects(_frac_a(spark, sf), EFFECT_COMPARISONS))


@query()
def effort_effect_tests(spark, sf):
    f = _frac_a(spark, sf)
    d = X.paired_differences(f, EFFECT_COMPARISONS).join(X.paired_effects(f, EFFECT_COMPARISONS).select("comparison"), "comparison", "left_semi")
    return ST.wilcoxon_test(d.withColumn("diff", F.round("diff", 12)), ["comparison"], "diff", "greater")


_SEPARATION = f"""{EMB}, ek AS (SELECT *, {_K.format('row_idx')} AS kind FROM e), ct(contrast, lk, le, rk, re) AS (VALUES {_values(CELL_CONTRASTS)}),
rw AS (SELECT contrast, keyword, 'lhs' AS side, row_idx, u, v FROM ct JOIN ek ON kind = lk AND effort = le UNION ALL SELECT contrast, keyword, 'rhs', row_idx, u, v FROM ct JOIN ek ON kind = rk AND effort = re),
nn AS (SELECT a.contrast, a.keyword, a.side AS own, b.side AS other, a.row_idx AS i, 1 - list_inner_product(a.u, b.u) AS d, row_number() OVER (PARTITION BY a.contrast, a.keyword, a.row_idx ORDER BY round(1 - list_inner_product(a.u, b.u), 12), b.side, b.row_idx) AS rank
       FROM rw a JOIN rw b ON a.contrast = b.contrast AND a.keyword = b.keyword AND a.row_idx <> b.row_idx),
sz AS (SELECT contrast, keyword, side, count(*) AS n FROM rw GROUP BY ALL),
ok AS (SELECT contrast, keyword FROM sz WHERE n > 1 GROUP BY ALL HAVING count(*) = 2),
pu AS (SELECT contrast, keyword, avg(CAST(own = other AS INT)) AS purity_1 FROM nn WHERE rank = 1 GROUP BY ALL),
ds AS (SELECT contrast, keyword, avg(d) FILTER (own <> other) AS cr, avg(d) FILTER (own = 'lhs' AND other = 'lhs') AS wl, avg(d) FILTER (own = 'rhs' AND other = 'rhs') AS wr FROM nn GROUP BY ALL),
cx AS (SELECT contrast, keyword, side, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM rw), cm AS (SELECT contrast, keyword, side, k, avg(x) AS m FROM cx GROUP BY ALL),
cd AS (SELECT a.contrast, a.keyword, 1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS centroid_distance FROM cm a JOIN cm b ON a.contrast = b.contrast AND a.keyword = b.keyword AND a.k = b.k WHERE a.side = 'lhs' AND b.side = 'rhs' GROUP BY ALL),
sep AS (SELECT contrast, keyword, purity_1, centroid_distance, cr / nullif((wl + wr) / 2, 0) AS cross_within_ratio FROM ok JOIN pu USING (contrast, keyword) JOIN ds USING (contrast, keyword) JOIN cd USING (contrast, keyword)),
pq AS (SELECT a.keyword, avg(1 - list_inner_product(a.u, b.u)) AS value FROM ek a JOIN ek b ON a.keyword = b.keyword AND a.kind = b.kind AND a.effort = b.effort AND a.row_idx < b.row_idx WHERE a.kind = 'default' AND a.effort = 'low' GROUP BY ALL),
{_pools('pq')},
sm AS (SELECT c.contrast, c.stratum, any_value(c.n) AS n, avg(purity_1) AS purity_1, avg(centroid_distance) AS centroid_distance, avg(cross_within_ratio) AS cross_within_ratio
       FROM (SELECT * FROM (SELECT DISTINCT contrast FROM sep), (SELECT stratum, count(*) AS n FROM st GROUP BY stratum)) c LEFT JOIN (SELECT * FROM sep JOIN st USING (keyword)) s ON c.contrast = s.contrast AND c.stratum = s.stratum GROUP BY ALL)"""
METRICS = ("purity_1", "centroid_distance", "cross_within_ratio")


def _separation(spark, sf, ks=(1,)):
    return X.cell_separation(_samples(spark, sf), CELL_CONTRASTS, ks)


@query(f"WITH {_SEPARATION} SELECT contrast, stratum, n, {', '.join(f'{r(m)} AS {m}' for m in METRICS)} FROM sm")
def separation_table(spark, sf):
    return B.tidy(X.separation_means(_separation(spark, sf), _strata(_cells(spark, sf)), METRICS))


@query(f"WITH {_SEPARATION} SELECT stratum, {r('min(purity_1)')} AS least, {r('median(purity_1)')} AS median, {r('max(purity_1)')} AS most, {r('max(purity_1) - min(purity_1)')} AS range FROM sm GROUP BY stratum")
def purity_roll_up(spark, sf):
    return B.tidy(X.roll_up(X.separation_means(_separation(spark, sf), _strata(_cells(spark, sf)), METRICS), ["stratum"], "purity_1"))


@query()
def separation_table_ci(spark, sf):
    """Intervals of all metrics and of purity at k = 1, 3, 5, 10, by contrast and stratum."""
    s = _separation(spark, sf, (1, 3, 5, 10)).join(_strata(_cells(spark, sf)), "keyword")
    names = ["centroid_distance", "cross_within_ratio", *(f"purity_{k}" for k in (1, 3, 5, 10))]
    return R.bootstrap_mean_ci(s.unpivot(["contrast", "stratum", "keyword"], names, "metric", "score"), ["contrast", "stratum", "metric"], "score", n_boot=10_000)


_Q2 = f"{SCORES}, qa AS (SELECT 'a' AS judge, * FROM q UNION ALL SELECT 'b', * FROM q2), qk AS (SELECT judge, keyword, {_K.format('row_idx')} AS kind, effort, {', '.join(f'avg({a}) AS {a}' for a in AXES)} FROM qa WHERE effort IN ('low', 'high') GROUP BY ALL)"


def _judge_cells(spark, sf):
    both = [_scores(spark, sf, k).withColumn("judge", F.lit("ab"[k])) for k in (0, 1)]
    return both[0].unionByName(both[1]).where(F.col("effort").isin("low", "high"))


@query(f"WITH {_Q2} SELECT judge, kind, effort, count(*) AS n_keywords, {', '.join(f'{r(f"avg({a})")} AS {a}' for a in AXES)} FROM qk GROUP BY ALL")
def quality_cells(spark, sf):
    return B.tidy(_judge_cells(spark, sf).groupBy("judge", "kind", "effort").agg(F.count("*").alias("n_keywords"), *(F.avg(a).alias(a) for a in AXES)))


@query(f"WITH {_Q2}, ql AS MATERIALIZED ({' UNION ALL '.join(f"SELECT judge, kind, effort, '{a}' AS axis, {a} AS score FROM qk" for a in AXES)}){B.boot_mean('ql', ['judge', 'kind', 'effort', 'axis'], 'score', 10_000)}")
def quality_cells_ci(spark, sf):
    long = _judge_cells(spark, sf).unpivot(["judge", "kind", "effort", "keyword"], list(AXES), "axis", "score")
    return B.tidy(R.bootstrap_mean_ci(long, ["judge", "kind", "effort", "axis"], "score", n_boot=10_000))


@query(f"WITH {_TWO}, {_kappa('effort, stratum')} SELECT 'weighted' AS kind, count(*) AS n_cells, {r('min(weighted_kappa)')} AS least, {r('median(weighted_kappa)')} AS median, {r('max(weighted_kappa)')} AS most, {r('max(weighted_kappa) - min(weighted_kappa)')} AS range FROM kp")
def kappa_roll_up(spark, sf):
    """Least, median and largest weighted kappa over the twelve cells of tier and stratum."""
    k = J.kappa(_two(spark, sf), ["effort", "stratum"], "a", "b").withColumn("kind", F.lit("weighted"))
    n = k.groupBy("kind").agg(F.count("*").alias("n_cells"))
    return B.tidy(n.join(X.roll_up(k, ["kind"], "weighted_kappa"), "kind"))


@query(f"""WITH {_CELLS}, x AS (SELECT kind, effort, value, 'overall' AS stratum FROM p UNION ALL SELECT kind, effort, value, stratum FROM p JOIN st USING (keyword)),
m AS (SELECT kind, stratum, avg(value) FILTER (effort = 'low') AS low, avg(value) FILTER (effort = 'high') AS high FROM x GROUP BY ALL) SELECT kind, stratum, {r('low')} AS low, {r('high')} AS high, {r('(high - low) * 100 / nullif(low, 0)', 4)} AS gain_percent FROM m""")
def effort_gain_by_stratum(spark, sf):
    from ..operators.tokens import relative_gain

    c = _cells(spark, sf)
    rows = c.withColumn("stratum", F.lit("overall")).unionByName(c.join(_strata(c), "keyword"))
    m = rows.groupBy("kind", "stratum", "effort").agg(F.avg("value").alias("value"))
    out = relative_gain(m, ["kind", "stratum"], "value")
    return B.tidy(out.withColumn("gain_percent", B.rounded(F.col("gain_percent"), 4)))


@query()
def vendi_by_cell(spark, sf):
    """Vendi scores of every keyword, kind and tier of the strata."""
    s = _samples(spark, sf).join(_strata(_cells(spark, sf)), "keyword")
    return SP.vendi_scores(s, ["stratum", "keyword", "kind", "effort"])


_CHANGES = f"""{EMB}, pr AS (SELECT a.keyword, a.effort, avg(1 - list_inner_product(a.u, b.u)) AS d FROM e a JOIN e b ON a.keyword = b.keyword AND a.effort = b.effort AND a.row_idx < b.row_idx GROUP BY ALL),
dd AS (SELECT 'src' || keyword AS keyword, max(d) FILTER (effort = 'high') - max(d) FILTER (effort = 'low') AS dx FROM pr GROUP BY keyword), {SCORES},
qq AS (SELECT keyword, effort, {', '.join(f'avg({a}) AS {a}' for a in AXES)} FROM q GROUP BY ALL),
qd AS ({' UNION ALL '.join(f"SELECT keyword, '{a}' AS axis, max({a}) FILTER (effort = 'high') - max({a}) FILTER (effort = 'low') AS dy FROM qq GROUP BY keyword" for a in AXES)}),
ch AS (SELECT axis, keyword, dx, dy FROM dd JOIN qd USING (keyword) WHERE dx IS NOT NULL AND dy IS NOT NULL)"""


def _changes(spark, sf):
    at = lambda c: F.max(F.when(F.col("effort") == "high", F.col(c))) - F.max(F.when(F.col("effort") == "low", F.col(c)))
    d = D.mean_pairwise_distance(B.samples(spark, sf), small=None).groupBy(F.concat(F.lit("src"), "keyword").alias("keyword")).agg(at("mean_distance").alias("dx"))
    q = B.quality(spark, sf).groupBy("keyword", "effort").agg(*(F.avg(a).alias(a) for a in AXES)).groupBy("keyword").agg(*(at(a).alias(a) for a in AXES))
    return d.join(q.unpivot(["keyword"], list(AXES), "axis", "dy"), "keyword").where("dx is not null and dy is not null")


@query(f"WITH {_CHANGES} SELECT axis, count(*) AS n, {r('CASE WHEN count(*) > 1 AND stddev_pop(dx) * stddev_pop(dy) > 1e-12 THEN corr(dx, dy) END')} AS pearson, {r('CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN corr(rx, ry) END')} AS spearman FROM (SELECT *, {', '.join(f"rank() OVER (PARTITION BY axis ORDER BY {v}) + (count(*) OVER (PARTITION BY axis, {v}) - 1) / 2.0 AS r{v[1]}" for v in ('dx', 'dy'))} FROM (SELECT axis, round(dx, 9) AS dx, round(dy, 9) AS dy FROM ch)) GROUP BY axis")
def diversity_quality_correlation(spark, sf):
    """By axis: n, Pearson and Spearman between the changes of diversity and of quality from the low to the high tier."""
    return B.tidy(ST.correlations(_changes(spark, sf).withColumns({v: F.round(v, 9) for v in ("dx", "dy")}), ["axis"], "dx", "dy"))


@query(f"WITH {_CHANGES}, ch2 AS MATERIALIZED (SELECT axis, round(dx, 9) AS dx, round(dy, 9) AS dy FROM ch){B.boot_pearson('ch2', ['axis'], 'dx', 'dy')}")
def diversity_quality_correlation_ci(spark, sf):
    c = _changes(spark, sf).withColumns({v: F.round(v, 9) for v in ("dx", "dy")})
    return B.tidy(R.bootstrap_pearson_ci(c, ["axis"], "dx", "dy"))
