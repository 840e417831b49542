"""Queries on distances of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diversity as D
from ..operators import neighbours as N
from ..operators import selection as S
from . import base as B
from .base import COORDS, EMB, PAIRS, STRATIFIED, query, r


@query(f"WITH {PAIRS} SELECT keyword, effort, count(DISTINCT row_idx) AS n, coalesce({r('avg(distance)')}, 0.0) AS mean_distance FROM e LEFT JOIN pairs USING (keyword, effort) GROUP BY ALL")
def mean_pairwise_distance(spark, sf):
    return B.tidy(D.mean_pairwise_distance(B.samples(spark, sf)))


@query(f"WITH {PAIRS} SELECT keyword, effort, count(*) AS n_pairs, {r('avg(distance)')} AS mean_distance, {r('median(distance)')} AS median_distance, {r('stddev_pop(distance)')} AS std_distance FROM pairs GROUP BY ALL")
def median_pairwise_distance(spark, sf):
    return B.tidy(D.pair_summary(B.samples(spark, sf)))


@query(f"WITH {PAIRS} SELECT effort, count(*) AS n_pairs, {r('avg(distance)')} AS mean_distance, {r('median(distance)')} AS median_distance, {r('stddev_pop(distance)')} AS std_distance FROM pairs GROUP BY ALL")
def pooled_pair_summary(spark, sf):
    return B.tidy(D.pair_summary(B.samples(spark, sf), D.GROUP, ["effort"]))


CENTROIDS = (
    COORDS
    + """,
cm AS (SELECT keyword, effort, k, avg(x) AS m FROM c GROUP BY ALL),
cn AS (SELECT keyword, effort, sqrt(sum(m * m)) AS l FROM cm GROUP BY ALL),
cu AS (SELECT keyword, effort, k, m / CASE WHEN l = 0 THEN 1 ELSE l END AS m FROM cm JOIN cn USING (keyword, effort))"""
)


@query(f"WITH {CENTROIDS}, d AS (SELECT row_idx, keyword, effort, 1 - sum(y * m) AS d FROM c JOIN cu USING (keyword, effort, k) GROUP BY ALL) SELECT keyword, effort, {r('avg(d)')} AS mean_to_centroid, {r('stddev_pop(d)')} AS std_to_centroid FROM d GROUP BY ALL")
def centroid_distance_stats(spark, sf):
    return B.tidy(D.centroid_spread(B.samples(spark, sf)))


@query(f"WITH {CENTROIDS} SELECT a.keyword || '|' || a.effort AS a, b.keyword || '|' || b.effort AS b, {r('least(2, greatest(0, 1 - sum(a.m * b.m)))')} AS distance FROM cu a JOIN cu b ON a.k = b.k GROUP BY a.keyword, a.effort, b.keyword, b.effort")
def centroid_matrix(spark, sf):
    return B.tidy(D.centroid_matrix(B.samples(spark, sf)))


def _summary_input(spark, sf):
    """Vectors with the text of the same id and the token counts of the event of the same id."""
    e = B.samples(spark, sf).drop("keyword")
    d = B.texts(spark, sf).select("row_idx", "keyword", "category", T.word_count(F.col("idea")).alias("word_count"), F.length("idea").alias("char_count"))
    k = B.token_rows(spark, sf).select(F.col("sample_index").alias("row_idx"), "input_tokens", "output_tokens", "total_tokens", "prompt")
    j = e.join(d, "row_idx").join(k, "row_idx")
    return j.select("*", (F.col("prompt") != "view").alias("has_reasoning_block"), F.when(F.col("prompt") == "error", "MAX_TOKENS").otherwise("end_turn").alias("stop_reason"), F.when(F.col("prompt") == "signup", "failed").otherwise("passed").alias("validation_status"))


def _summary(spark, sf):
    return D.keyword_effort_summary(_summary_input(spark, sf), ("category", "effort"))


SUMMARY = (
    EMB
    + ","
    + B.TOKENS
    + r""",
s AS (SELECT e.row_idx, e.effort, e.u, e.v, d.lang AS category,
             CASE WHEN trim(regexp_replace(d.text, '[\s]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(d.text, '[\s]+', ' ', 'g')), ' ')) END AS word_count,
             length(d.text) AS char_count, k.input_tokens, k.output_tokens, k.total_tokens, k.prompt
      FROM e JOIN documents d ON d.doc_id = e.row_idx JOIN k ON k.sample_index = e.row_idx),
sp AS (SELECT a.category, a.effort, least(2, greatest(0, 1 - list_inner_product(a.u, b.u))) AS d FROM s a JOIN s b ON a.category = b.category AND a.effort = b.effort AND a.row_idx < b.row_idx),
spd AS (SELECT category, effort, avg(d) AS mean_d, median(d) AS median_d FROM sp GROUP BY ALL),
sx AS (SELECT row_idx, category, effort, unnest(v) AS x, unnest(u) AS y, generate_subscripts(v, 1) AS i FROM s),
sc AS (SELECT category, effort, i, avg(x) AS m FROM sx GROUP BY ALL), scn AS (SELECT category, effort, sqrt(sum(m * m)) AS l FROM sc GROUP BY ALL),
sd AS (SELECT row_idx, category, effort, 1 - sum(y * m / l) AS d FROM sx JOIN sc USING (category, effort, i) JOIN scn USING (category, effort) GROUP BY ALL),
sdd AS (SELECT category, effort, avg(d) AS mean_c, stddev_pop(d) AS std_c FROM sd GROUP BY ALL),
summary AS (SELECT category, effort, count(*) AS n, avg(word_count) AS mean_word_count, avg(char_count) AS mean_char_count,
    avg(CAST(prompt <> 'view' AS INT)) AS reasoning_block_rate, avg(CAST(prompt = 'error' AS INT)) AS max_tokens_stop_rate, avg(CAST(prompt <> 'signup' AS INT)) AS validation_pass_rate,
    avg(input_tokens) AS mean_input_tokens, avg(output_tokens) AS mean_output_tokens, avg(total_tokens) AS mean_total_tokens, max(output_tokens) AS max_output_tokens,
    coalesce(any_value(mean_d), 0) AS mean_pairwise_distance, coalesce(any_value(median_d), 0) AS median_pairwise_distance, any_value(mean_c) AS mean_to_centroid, any_value(std_c) AS std_to_centroid
  FROM s LEFT JOIN spd USING (category, effort) LEFT JOIN sdd USING (category, effort) GROUP BY ALL)"""
)
_COLS = ("mean_word_count", "mean_char_count", "reasoning_block_rate", "max_tokens_stop_rate", "validation_pass_rate", "mean_input_tokens", "mean_output_tokens", "mean_total_tokens", "mean_pairwise_distance", "median_pairwise_distance", "mean_to_centroid", "std_to_centroid")


@query(f"WITH {SUMMARY} SELECT category, effort, n, max_output_tokens, {', '.join(f'{r(c)} AS {c}' for c in _COLS)} FROM summary")
def keyword_effort_summary(spark, sf):
    return B.tidy(_summary(spark, sf))


@query(f"WITH {SUMMARY} SELECT effort, count(*) AS n_keywords, CAST(sum(n) AS BIGINT) AS n_samples, max(max_output_tokens) AS max_output_tokens, {', '.join(f'{r(f"avg({c})")} AS {c}' for c in _COLS)} FROM summary GROUP BY effort")
def effort_summary(spark, sf):
    return B.tidy(D.effort_summary(_summary(spark, sf), _COLS, most="max_output_tokens"))


@query(f"WITH {SUMMARY} SELECT category, effort, count(*) AS n_keywords, {r('avg(mean_pairwise_distance)')} AS mean, {r('stddev_pop(mean_pairwise_distance)')} AS std, {r('min(mean_pairwise_distance)')} AS least, {r('max(mean_pairwise_distance)')} AS most FROM summary WHERE trim(coalesce(category, '')) <> '' GROUP BY ALL")
def category_summary(spark, sf):
    return B.tidy(D.category_summary(_summary(spark, sf), "mean_pairwise_distance"))


_SIDES = (
    COORDS
    + """,
g AS (SELECT keyword, gen, k, sum(y) AS s, avg(x) AS m FROM c GROUP BY ALL), gn AS (SELECT keyword, gen, count(*) AS n, sum(list_inner_product(u, u)) AS q FROM e GROUP BY ALL),
gw AS (SELECT keyword, gen, n, q, sum(s * s) AS ss, sum(m * m) AS mm FROM g JOIN gn USING (keyword, gen) GROUP BY ALL),
gx AS (SELECT a.keyword, a.gen AS gen_a, b.gen AS gen_b, sum(a.s * b.s) AS ab, sum(a.m * b.m) AS mab FROM g a JOIN g b ON a.keyword = b.keyword AND a.k = b.k AND a.gen < b.gen GROUP BY ALL),
gj AS (SELECT x.*, a.n AS na, b.n AS nb, a.mm AS ma, b.mm AS mb, CASE WHEN a.n > 1 THEN 1 - (a.ss - a.q) / (a.n * (a.n - 1)) END AS wa, CASE WHEN b.n > 1 THEN 1 - (b.ss - b.q) / (b.n * (b.n - 1)) END AS wb
       FROM gx x JOIN gw a ON a.keyword = x.keyword AND a.gen = gen_a JOIN gw b ON b.keyword = x.keyword AND b.gen = gen_b)"""
)


@query(f"WITH {_SIDES} SELECT keyword, gen_a, gen_b, {r('1 - ab / (na * nb)')} AS cross_distance, {r('CASE WHEN na > 1 AND nb > 1 THEN 1 - mab / (sqrt(ma) * sqrt(mb)) END')} AS centroid_distance, {r('CASE WHEN na > 1 AND nb > 1 THEN (1 - ab / (na * nb)) / nullif((wa + wb) / 2, 0) END')} AS cross_within_ratio FROM gj")
def cross_within_ratio(spark, sf):
    return B.tidy(D.cross_within(B.samples(spark, sf), "keyword", "gen"))


_ORDERED = EMB + ", op AS (SELECT a.effort, a.keyword AS ka, b.keyword AS kb, a.row_idx AS i, b.row_idx AS j, 1 - list_inner_product(a.u, b.u) AS d FROM e a JOIN e b ON a.effort = b.effort)"


@query(f"WITH {_ORDERED}, m AS (SELECT effort, avg(d) FILTER (ka = kb AND i <> j) AS intra, avg(d) FILTER (ka <> kb) AS inter, avg(d) AS rnd FROM op GROUP BY ALL) SELECT effort, {r('intra')} AS intra, {r('inter')} AS inter, {r('rnd')} AS random, {r('inter / nullif(intra, 0)')} AS separability FROM m")
def separability_exact(spark, sf):
    return B.tidy(D.separability(B.samples(spark, sf)))


_LOO = (
    _ORDERED
    + """, kk AS (SELECT DISTINCT keyword FROM e),
own AS (SELECT effort, ka AS keyword, avg(d) AS d FROM op WHERE ka = kb AND i <> j GROUP BY ALL),
w AS (SELECT effort, inter / nullif(intra, 0) AS s FROM (SELECT effort, avg(d) AS inter FROM op WHERE ka <> kb GROUP BY effort) JOIN (SELECT effort, avg(d) AS intra FROM own GROUP BY effort) USING (effort)),
li AS (SELECT op.effort, kk.keyword, avg(d) AS inter FROM op JOIN kk ON ka <> keyword AND kb <> keyword WHERE ka <> kb GROUP BY ALL),
la AS (SELECT own.effort, kk.keyword, avg(d) AS intra FROM own JOIN kk ON own.keyword <> kk.keyword GROUP BY ALL),
l AS (SELECT k2.effort, k2.keyword, inter / nullif(intra, 0) AS s FROM (SELECT DISTINCT effort, keyword FROM e) k2 LEFT JOIN li USING (effort, keyword) LEFT JOIN la USING (effort, keyword))"""
)


@query(f"WITH {_LOO} SELECT l.effort, l.keyword, {r('l.s')} AS separability, {r('l.s - w.s')} AS shift FROM l JOIN w USING (effort)")
def leave_one_out(spark, sf):
    return B.tidy(D.leave_one_out(B.samples(spark, sf)))


@query(f"WITH {_LOO}, x AS (SELECT l.effort, l.keyword, abs(l.s - w.s) AS a FROM l JOIN w USING (effort)) SELECT effort, arg_max(keyword, (a, keyword)) FILTER (a IS NOT NULL) AS keyword, {r('max(a)')} AS largest_shift FROM x GROUP BY effort")
def most_influential_keyword(spark, sf):
    return B.tidy(D.most_influential(D.leave_one_out(B.samples(spark, sf))))


_MEANS = PAIRS + ", m AS (SELECT keyword, effort, avg(distance) AS d FROM pairs GROUP BY ALL)"


@query(f"WITH {_MEANS} SELECT effort, {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS std, {r('stddev_pop(d) / avg(d)')} AS cv FROM m GROUP BY ALL")
def keyword_variation(spark, sf):
    return B.tidy(D.per_group_variation(D.mean_pairwise_distance(B.samples(spark, sf), small=None), "mean_distance", ["effort"]))


@query(f"WITH {_MEANS} SELECT keyword, {', '.join(f"{r(f"max(d) FILTER (effort = '{x}')")} AS \"{x}\"" for x in ('none', 'low', 'medium', 'high'))} FROM m GROUP BY keyword")
def facet_diversity_pivot(spark, sf):
    return B.tidy(D.pivot_efforts(D.mean_pairwise_distance(B.samples(spark, sf), small=None), ["keyword"], "mean_distance", ["none", "low", "medium", "high"]))


@query(f"WITH {_MEANS}, x AS (SELECT keyword, max(d) FILTER (effort = 'low') AS low, max(d) FILTER (effort = 'high') AS high FROM m GROUP BY keyword) SELECT keyword, {r('low')} AS low, {r('high')} AS high, {r('high - low')} AS change, {r('(high - low) / greatest(low, 1e-9)')} AS relative_change FROM x")
def low_high_change(spark, sf):
    return B.tidy(D.low_high_change(D.mean_pairwise_distance(B.samples(spark, sf), small=None), ["keyword"], "mean_distance"))


NEAR = (
    EMB
    + """,
np AS (SELECT a.keyword, a.row_idx AS i, b.row_idx AS j, a.gen AS gi, b.gen AS gj, least(2, greatest(0, 1 - list_inner_product(a.u, b.u))) AS d FROM e a JOIN e b ON a.keyword = b.keyword AND a.row_idx <> b.row_idx),
nr AS (SELECT *, row_number() OVER (PARTITION BY keyword, i ORDER BY round(d, 12), gj, j) AS rank FROM np)"""
)


def _near(spark, sf, k=10):
    return N.neighbours(B.samples(spark, sf), ["keyword"], "gen", k)


@query(f"WITH {NEAR}, x AS (SELECT keyword, i, k, avg(CAST(gi = gj AS INT)) AS s FROM nr, (VALUES (1), (3), (5), (10)) AS ks(k) WHERE rank <= k GROUP BY ALL) SELECT keyword, CAST(k AS BIGINT) AS k, count(*) AS n, {r('avg(s)')} AS purity FROM x GROUP BY ALL")
def soft_knn_purity(spark, sf):
    return B.tidy(N.soft_purity(_near(spark, sf), ["keyword"], [1, 3, 5, 10]))


@query(f"WITH {NEAR} SELECT keyword, count(*) AS n, CAST(1 AS BIGINT) AS k, {r('avg(CAST(gi = gj AS INT))')} AS purity FROM nr WHERE rank = 1 GROUP BY keyword")
def nn_purity(spark, sf):
    return B.tidy(N.soft_purity(_near(spark, sf, 1), ["keyword"], [1]))


@query(f"WITH {NEAR}, x AS (SELECT keyword, i, gi, avg(CAST(gi = gj AS INT)) AS s FROM nr WHERE rank <= 10 GROUP BY ALL) SELECT keyword, gi AS label, count(*) AS n, {r('avg(s)')} AS purity FROM x GROUP BY ALL")
def knn_purity_panel(spark, sf):
    return B.tidy(N.panel_purity(_near(spark, sf), ["keyword"]))


@query(f"WITH {NEAR}, x AS (SELECT keyword, i, gi, avg(CAST(gi = gj AS INT)) AS s FROM nr WHERE rank <= 10 GROUP BY ALL), y AS (SELECT keyword, gi, avg(s) AS purity FROM x GROUP BY ALL) SELECT gi AS label, count(*) AS n_panels, {r('avg(purity)')} AS mean_purity FROM y GROUP BY gi")
def knn_purity_overall(spark, sf):
    return B.tidy(N.mean_over_panels(N.panel_purity(_near(spark, sf), ["keyword"]), ["label"], "purity"))


@query(f"WITH {NEAR}, x AS (SELECT keyword, gi, avg(d) FILTER (gi = gj) AS w, avg(d) FILTER (gi <> gj) AS b FROM np GROUP BY ALL) SELECT keyword, gi AS label, {r('w')} AS within, {r('b')} AS between, {r('w / nullif(b, 0)')} AS ratio FROM x")
def label_distances(spark, sf):
    return B.tidy(N.label_distances(B.samples(spark, sf), ["keyword"], "gen"))


@query(f"WITH {NEAR}, t AS (SELECT keyword, i, gi, gj, avg(d) AS d FROM np GROUP BY ALL), x AS (SELECT keyword, i, gi, max(d) FILTER (gi = gj) AS a, min(d) FILTER (gi <> gj) AS b FROM t GROUP BY ALL), y AS (SELECT *, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM x) SELECT keyword, count(*) AS n, count(DISTINCT gi) AS labels, {r('CASE WHEN count(DISTINCT gi) > 1 AND count(*) > count(DISTINCT gi) THEN avg(s) END')} AS silhouette FROM y GROUP BY keyword")
def silhouette(spark, sf):
    return B.tidy(N.silhouette(B.samples(spark, sf), ["keyword"], "gen"))


@query(f"WITH {STRATIFIED} SELECT keyword, effort, i, j, {r('distance')} AS distance, stratum, rank FROM strat")
def stratified_pairs(spark, sf):
    return B.tidy(S.stratified_pairs(B.samples(spark, sf), D.GROUP, 5, short="all"))


@query(f"""WITH {STRATIFIED}, {B.TEXTS}, x AS (SELECT s.keyword, s.effort, i, j, {r('distance')} AS distance, stratum, rank, 'judge' AS judge, unnest(['ab', 'ba']) AS "order", a.idea AS ta, b.idea AS tb
  FROM strat s JOIN t a ON a.row_idx = i JOIN t b ON b.row_idx = j) SELECT keyword, effort, i, j, distance, stratum, rank, judge, "order", CASE WHEN "order" = 'ab' THEN ta ELSE tb END AS text_a, CASE WHEN "order" = 'ab' THEN tb ELSE ta END AS text_b FROM x""")
def judge_requests_both_orders(spark, sf):
    p = S.stratified_pairs(B.samples(spark, sf), D.GROUP, 5, short="all")
    return B.tidy(S.judge_requests(p, B.texts(spark, sf).select("row_idx", "idea"), "judge"))


@query(f"WITH {_MEANS}, x AS (SELECT *, row_number() OVER (PARTITION BY effort ORDER BY d, keyword) AS rn, count(*) OVER (PARTITION BY effort) AS n FROM m) SELECT effort, keyword, {r('d', 9)} AS mean_distance, CASE WHEN rn <= n // 4 THEN 'Q1' ELSE 'Q4' END AS stratum FROM x WHERE rn <= n // 4 OR rn > n - n // 4")
def quartile_pools(spark, sf):
    m = D.mean_pairwise_distance(B.samples(spark, sf), small=None).drop("n")
    return B.tidy(S.quartile_pools(m.withColumn("mean_distance", F.round("mean_distance", 9)), ["effort"], "mean_distance", "keyword"), 9)


@query(f"WITH {_MEANS}, x AS (SELECT *, row_number() OVER (PARTITION BY effort ORDER BY d, keyword) AS rn, count(*) OVER (PARTITION BY effort) AS n FROM m) SELECT effort, keyword, {r('d', 9)} AS mean_distance, CASE WHEN rn <= n // 2 THEN 'lower' ELSE 'upper' END AS half FROM x")
def median_split(spark, sf):
    m = D.mean_pairwise_distance(B.samples(spark, sf), small=None).drop("n")
    return B.tidy(S.median_split(m.withColumn("mean_distance", F.round("mean_distance", 9)), ["effort"], "mean_distance", "keyword"), 9)


@query(f"""WITH {_MEANS}, x AS (SELECT keyword, effort, row_number() OVER (PARTITION BY effort ORDER BY round(d, 9), keyword) AS rn, count(*) OVER (PARTITION BY effort) AS n FROM m), y AS (SELECT keyword, effort, CASE WHEN rn <= n // 4 THEN 'Q1' ELSE 'Q4' END AS stratum FROM x WHERE rn <= n // 4 OR rn > n - n // 4),
z AS (SELECT stratum, keyword, count(DISTINCT effort) AS n_models FROM y GROUP BY ALL) SELECT stratum, n_models, count(*) AS n_keys FROM z GROUP BY ALL""")
def selection_overlap(spark, sf):
    m = D.mean_pairwise_distance(B.samples(spark, sf), small=None).withColumn("mean_distance", F.round("mean_distance", 9))
    return S.overlap(S.quartile_pools(m, ["effort"], "mean_distance", "keyword"), ["stratum"], "keyword", "effort")
