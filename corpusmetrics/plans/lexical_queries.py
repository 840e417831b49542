"""Queries on wording and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.columns import hyphen_slug, template_key, text_key, underscore_slug
from ..functions.constants import LEXICAL_TOKEN, SHARED_STOPWORDS, SHARED_TOKEN, VOCABULARY_STOPWORDS, VOCABULARY_TOKEN
from ..operators import lexical as L
from ..operators import permutation as PM
from . import base as B
from .base import TEXTS, query, r

_W = f"WITH {TEXTS}"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tokens(text: str, pattern: str) -> str:
    return f"regexp_extract_all(lower({text}), {_quoted(pattern)}, 0)"


def _without(text: str, pattern: str, stop: list[str]) -> str:
    return f"list_filter({_tokens(text, pattern)}, lambda w: len(w) > 2 AND NOT list_contains([{', '.join(map(_quoted, sorted(set(stop))))}], w))"


_FACETS = f"""{_W}, fc AS (SELECT row_idx, keyword, category, effort, 'purpose' AS facet, purpose AS text FROM t UNION ALL SELECT row_idx, keyword, category, effort, 'mechanism', mechanism FROM t
UNION ALL SELECT row_idx, keyword, category, effort, 'evaluation', evaluation FROM t UNION ALL SELECT row_idx, keyword, category, effort, 'combined', purpose || ' ' || mechanism || ' ' || evaluation FROM t),
tk AS (SELECT row_idx, category, effort, facet, {_tokens('text', LEXICAL_TOKEN)} AS w FROM fc),
ns AS (SELECT unnest(generate_series(1, 6)) AS n),
gr AS (SELECT row_idx, category, effort, facet, CAST(n AS BIGINT) AS n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM tk, ns WHERE len(w) >= n)"""


def _facets(spark, sf):
    return L.facet_rows(B.texts(spark, sf), ["row_idx", "category", "effort"])


_BY = ["category", "effort", "facet"]
_GRID = "grid AS (SELECT DISTINCT category, effort, facet, CAST(n AS BIGINT) AS n FROM tk, ns)"


@query(f"{_FACETS}, {_GRID}, h AS (SELECT category, effort, facet, n, count(DISTINCT gram) / count(*) AS d, count(*) AS total FROM gr GROUP BY ALL) SELECT category, effort, facet, n, {r('coalesce(d, 0)')} AS distinct_n, coalesce(total, 0) AS total FROM grid LEFT JOIN h USING (category, effort, facet, n)")
def distinct_n(spark, sf):
    return B.tidy(L.distinct_n(_facets(spark, sf), _BY, 6, nested="facet"))


@query(f"{_FACETS}, {_GRID}, h AS (SELECT category, effort, facet, n, count(DISTINCT gram) / count(*) AS d FROM gr GROUP BY ALL), g2 AS (SELECT category, effort, facet, n, coalesce(d, 0) AS d FROM grid LEFT JOIN h USING (category, effort, facet, n)) SELECT facet, effort, n, count(*) AS n_buckets, {r('avg(d)')} AS mean, {r('stddev_pop(d)')} AS std FROM g2 GROUP BY ALL")
def lexical_aggregate(spark, sf):
    return B.tidy(L.lexical_aggregate(L.distinct_n(_facets(spark, sf), _BY, 6, nested="facet"), ["facet", "effort", "n"], "distinct_n"))


@query(f"{_FACETS}, {_GRID}, h AS (SELECT category, effort, facet, n, count(DISTINCT gram) / count(*) AS d FROM gr GROUP BY ALL), g2 AS (SELECT category, effort, facet, n, coalesce(d, 0) AS d FROM grid LEFT JOIN h USING (category, effort, facet, n)), m AS (SELECT facet, effort, n, avg(d) AS mean FROM g2 GROUP BY ALL) SELECT a.facet, a.n, a.effort, {r('a.mean')} AS mean, {r('a.mean / nullif(b.mean, 0)')} AS relative FROM m a JOIN m b ON a.facet = b.facet AND a.n = b.n AND b.effort = 'low'")
def lexical_relative(spark, sf):
    a = L.lexical_aggregate(L.distinct_n(_facets(spark, sf), _BY, 6, nested="facet"), ["facet", "effort", "n"], "distinct_n")
    return B.tidy(L.relative_to(a, ["facet", "n"], "mean"))


_BLEU = f"""{_FACETS}, c AS (SELECT category, effort, facet, row_idx, n, gram, count(*) AS c FROM gr GROUP BY ALL),
l AS (SELECT category, effort, facet, row_idx, len(w) AS len FROM tk),
pr AS (SELECT a.category, a.effort, a.facet, a.row_idx AS i, b.row_idx AS j, a.len AS c, b.len AS r FROM l a JOIN l b ON a.category = b.category AND a.effort = b.effort AND a.facet = b.facet AND a.row_idx <> b.row_idx),
cl AS (SELECT category, effort, facet, i, any_value(c) AS c, arg_min(r, abs(r - c) * 1000000 + r) AS r FROM pr GROUP BY ALL),
ref AS (SELECT a.category, a.effort, a.facet, a.row_idx, a.n, a.gram, any_value(a.c) AS c, coalesce(max(b.c), 0) AS m FROM c a LEFT JOIN c b ON a.category = b.category AND a.effort = b.effort AND a.facet = b.facet AND a.n = b.n AND a.gram = b.gram AND a.row_idx <> b.row_idx GROUP BY ALL),
hits AS (SELECT category, effort, facet, row_idx, n, sum(least(c, m)) AS hit, sum(c) AS total FROM ref GROUP BY ALL),
p AS (SELECT cl.category, cl.effort, cl.facet, cl.i, CAST(ns.n AS BIGINT) AS n, cl.c, cl.r, coalesce(hit, 0) AS hit, coalesce(total, 0) AS total FROM cl, ns LEFT JOIN hits h ON h.category = cl.category AND h.effort = cl.effort AND h.facet = cl.facet AND h.row_idx = cl.i AND h.n = ns.n),
q AS (SELECT *, sum(ln(CASE WHEN hit > 0 THEN hit ELSE 0.1 END / greatest(total, 1))) OVER w AS s, first_value(hit) OVER w AS hit1 FROM p WINDOW w AS (PARTITION BY category, effort, facet, i ORDER BY n)),
sc AS (SELECT *, CASE WHEN hit1 = 0 OR c = 0 THEN 0 ELSE (CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END) * exp(s / n) END AS b FROM q)
SELECT category, effort, facet, n, count(*) AS n_texts, {r('avg(b)')} AS self_bleu FROM sc GROUP BY ALL"""


@query(_BLEU)
def self_bleu_relational(spark, sf):
    return B.tidy(L.self_bleu(_facets(spark, sf), _BY, 6, nested="facet"))


_VOC = f"{_W}, vc AS (SELECT category, keyword, unnest({_without('idea', VOCABULARY_TOKEN, VOCABULARY_STOPWORDS)}) AS token FROM t), v AS (SELECT category, keyword, token, count(*) AS tf FROM vc GROUP BY ALL)"
_SHARED = f"{_W}, vc AS (SELECT row_idx, category, keyword, unnest({_without('idea', SHARED_TOKEN, SHARED_STOPWORDS)}) AS token FROM t), v AS (SELECT keyword, token, count(*) AS tf FROM vc GROUP BY ALL)"


def _vocabulary(spark, sf):
    return L.vocabulary(B.texts(spark, sf), ["category", "keyword"], T.vocabulary_tokens(F.col("idea")))


def _keys(spark, sf):
    return B.texts(spark, sf).select("category", "keyword").distinct()


def _shared(spark, sf):
    return L.vocabulary(B.texts(spark, sf), ["keyword"], T.shared_tokens(F.col("idea")))


@query(f"{_VOC}, ks AS (SELECT DISTINCT category, keyword FROM t), sz AS (SELECT category, keyword, count(token) AS n FROM ks LEFT JOIN v USING (category, keyword) GROUP BY ALL), bo AS (SELECT a.category, a.keyword AS ka, b.keyword AS kb, count(*) AS c FROM v a JOIN v b ON a.category = b.category AND a.token = b.token AND a.keyword < b.keyword GROUP BY ALL), pr AS (SELECT a.category, coalesce(c, 0) / nullif(a.n + b.n - coalesce(c, 0), 0) AS j FROM sz a JOIN sz b ON a.category = b.category AND a.keyword < b.keyword LEFT JOIN bo ON bo.category = a.category AND ka = a.keyword AND kb = b.keyword), nk AS (SELECT category, count(*) AS n_keys FROM sz GROUP BY ALL) SELECT category, n_keys, {r('coalesce(avg(j), 0)')} AS mean_jaccard FROM nk LEFT JOIN pr USING (category) GROUP BY ALL")
def vocab_jaccard(spark, sf):
    return B.tidy(L.vocabulary_jaccard(_vocabulary(spark, sf), ["category"], "keyword", _keys(spark, sf)))


_IDF = f"{_VOC}, df AS (SELECT category, token, count(*) AS df FROM v GROUP BY ALL), nn AS (SELECT category, count(DISTINCT keyword) AS n FROM t GROUP BY ALL), tt AS (SELECT category, keyword, sum(tf) AS tokens FROM v GROUP BY ALL), sc AS (SELECT v.*, ln(n / df) AS idf, tf / tokens * ln(n / df) AS ti FROM v JOIN df USING (category, token) JOIN nn USING (category) JOIN tt USING (category, keyword))"


@query(f"{_IDF} SELECT category, {r('sum(tf * idf) / sum(tf)')} AS mean_idf FROM sc GROUP BY ALL")
def idf_mean(spark, sf):
    return B.tidy(L.idf_mean(L.token_idf(_vocabulary(spark, sf), ["category"], "keyword", _keys(spark, sf)), ["category"]))


@query(f"{_IDF}, k AS (SELECT *, row_number() OVER (PARTITION BY category, keyword ORDER BY round(ti, 9) DESC, token) AS rank FROM sc) SELECT category, keyword, rank, token, tf, {r('ti')} AS tf_idf FROM k WHERE rank <= 10")
def top_tfidf(spark, sf):
    return B.tidy(L.top_terms(L.tf_idf(_vocabulary(spark, sf), ["category"], "keyword", _keys(spark, sf)), ["category", "keyword"], 10))


_UNI = f"{_SHARED}, u AS (SELECT token, count(DISTINCT keyword) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM v GROUP BY token HAVING count(DISTINCT keyword) >= floor((SELECT count(DISTINCT keyword) FROM t) * 0.9))"


@query(f"{_UNI} SELECT * FROM u")
def universal_words(spark, sf):
    return L.universal_words(_shared(spark, sf), "keyword", _keys(spark, sf))


@query(f"{_UNI}, s AS (SELECT category, row_idx, avg(CASE WHEN u.token IS NULL THEN 0 ELSE 1 END) AS s FROM vc LEFT JOIN u USING (token) GROUP BY ALL) SELECT category, count(*) AS n_texts, {r('avg(s)')} AS universal_share FROM s GROUP BY ALL")
def universal_share(spark, sf):
    words = L.universal_words(_shared(spark, sf), "keyword", _keys(spark, sf))
    return B.tidy(L.universal_share(B.texts(spark, sf), ["category"], T.shared_tokens(F.col("idea")), words))


@query(f"{_SHARED}, d AS (SELECT token, count(DISTINCT keyword) AS df FROM v GROUP BY token) SELECT CASE WHEN df = 1 THEN '1' WHEN df <= 5 THEN '2-5' WHEN df <= 15 THEN '6-15' ELSE '>=16' END AS bucket, count(*) AS n_tokens FROM d GROUP BY ALL")
def df_histogram(spark, sf):
    return L.df_histogram(_shared(spark, sf), "keyword")


@query(f"{_W} SELECT category, count(*) AS n, {r("avg(CAST(contains(lower(idea), lower(category)) AS INT))")} AS coverage FROM t GROUP BY category")
def keyword_coverage(spark, sf):
    return B.tidy(L.keyword_coverage(B.texts(spark, sf), ["category"], "category"))


_STRINGS = f"{_W}, s AS (SELECT row_idx, keyword, idea AS s FROM t)"
_ENT = ", ch AS (SELECT row_idx, unnest(string_split(s, '')) AS c FROM s WHERE length(s) > 0), cn AS (SELECT row_idx, c, count(*) AS n FROM ch GROUP BY ALL), ct AS (SELECT row_idx, sum(n) AS n FROM cn GROUP BY ALL), en AS (SELECT row_idx, -sum(cn.n / ct.n * log2(cn.n / ct.n)) AS e FROM cn JOIN ct USING (row_idx) GROUP BY ALL)"


def _strings(spark, sf):
    return B.texts(spark, sf).select("row_idx", "keyword", "category", F.col("idea").alias("s"))


@query(f"{_STRINGS}{_ENT} SELECT row_idx, {r('coalesce(e, 0)')} AS entropy FROM s LEFT JOIN en USING (row_idx)")
def char_entropy(spark, sf):
    return B.tidy(_strings(spark, sf).select("row_idx", T.char_entropy(F.col("s")).alias("entropy")))


@query(f"{_STRINGS}, p AS (SELECT keyword, substr(s, 1, 7) AS p, count(*) AS c FROM s GROUP BY ALL) SELECT keyword, {r('max(c) / sum(c)')} AS modal_prefix_share FROM p GROUP BY keyword")
def prefix_share(spark, sf):
    return B.tidy(L.prefix_share(_strings(spark, sf), ["keyword"], "s"))


@query(f"{_STRINGS}{_ENT}, p AS (SELECT keyword, substr(s, 1, 7) AS p, count(*) AS c FROM s GROUP BY ALL), pp AS (SELECT keyword, max(c) / sum(c) AS m FROM p GROUP BY keyword) SELECT keyword, count(*) AS n, {r('count(DISTINCT s) / count(*)')} AS unique_share, {r('avg(length(s))')} AS mean_length, {r('stddev_pop(length(s))')} AS std_length, {r('avg(coalesce(e, 0))')} AS mean_entropy, {r('any_value(m)')} AS modal_prefix_share FROM s LEFT JOIN en USING (row_idx) JOIN pp USING (keyword) GROUP BY keyword")
def string_diagnostics(spark, sf):
    return B.tidy(L.string_diagnostics(_strings(spark, sf), ["keyword"], "s"))


@query(f"{_STRINGS}, b AS (SELECT row_idx, keyword, CASE WHEN length(s) > 1 THEN list_distinct(list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i, 2))) WHEN length(s) = 1 THEN [s] ELSE [] END AS b FROM s), d AS (SELECT x.keyword, CASE WHEN len(list_distinct(x.b || y.b)) = 0 THEN 0 ELSE 1 - len(list_intersect(x.b, y.b)) / len(list_distinct(x.b || y.b)) END AS d FROM b x JOIN b y ON x.keyword = y.keyword AND x.row_idx < y.row_idx) SELECT keyword, count(*) AS n_pairs, {r('avg(d)')} AS mean_distance, {r('median(d)')} AS median_distance FROM d GROUP BY keyword")
def bigram_jaccard(spark, sf):
    return B.tidy(L.string_distance_summary(_strings(spark, sf), ["keyword"], "s").drop("std_distance"))


#: Texts and vectors of one id; the draws of text_vector_correlation said in SQL.
_OBJECTS = f"""{B.EMB}, {_STRINGS.removeprefix("WITH ")},
b AS MATERIALIZED (SELECT s.keyword, s.row_idx AS i, e.u, CASE WHEN length(s) > 1 THEN list_distinct(list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i, 2))) WHEN length(s) = 1 THEN [s] ELSE [] END AS b,
             row_number() OVER (PARTITION BY s.keyword ORDER BY s.row_idx) AS k FROM s JOIN e USING (row_idx)),
d AS MATERIALIZED (SELECT x.keyword, x.i, y.i AS j, x.k, y.k AS l,
             floor(1048576 * round(CASE WHEN len(x.b) + len(y.b) = 0 THEN 0 ELSE 1 - len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) END, 12)) AS x,
             floor(1048576 * round(least(2, greatest(0, 1 - list_inner_product(x.u, y.u))), 12)) AS y FROM b x JOIN b y ON x.keyword = y.keyword AND x.i < y.i),
ranked AS MATERIALIZED (SELECT keyword, i, j, k, l, rank() OVER (PARTITION BY keyword ORDER BY x) + (count(*) OVER (PARTITION BY keyword, x) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY keyword ORDER BY y) + (count(*) OVER (PARTITION BY keyword, y) - 1) / 2.0 AS ry FROM d),
slots AS MATERIALIZED (SELECT keyword, draw, i, row_number() OVER (PARTITION BY keyword, draw ORDER BY md5(concat('42:', draw, ':', i)), i) AS k FROM b, generate_series(0, 199) g(draw)),
sym AS MATERIALIZED (SELECT keyword, i, j, rx FROM ranked UNION ALL SELECT keyword, j, i, rx FROM ranked),
moved AS MATERIALIZED (SELECT y.keyword, a.draw, a.i, c.i AS j, y.ry FROM ranked y JOIN slots a ON y.keyword = a.keyword AND y.k = a.k JOIN slots c ON y.keyword = c.keyword AND y.l = c.k AND a.draw = c.draw),
drawn AS MATERIALIZED (SELECT keyword, draw, corr(rx, ry) AS r FROM moved JOIN sym USING (keyword, i, j) GROUP BY ALL),
seen AS (SELECT keyword, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM ranked GROUP BY keyword)"""


@query(f"WITH {_OBJECTS.removeprefix('WITH ').lstrip()} SELECT keyword, any_value(n) AS n, {r('any_value(rho)')} AS rho, {r('avg(drawn.r)')} AS null_mean, {r('avg(CAST(abs(drawn.r) >= abs(rho) - 1e-9 AS INT))')} AS p FROM seen JOIN drawn USING (keyword) JOIN (SELECT keyword, count(*) AS n FROM b GROUP BY keyword) USING (keyword) GROUP BY keyword")
def text_vector_correlation(spark, sf):
    vectors = B.samples(spark, sf).select("row_idx", "vec")
    return B.tidy(PM.text_vector_correlation(_strings(spark, sf).join(vectors, "row_idx"), ["keyword"], "s"))


@query(r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '[\s]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\s]+', ' ', 'g')), ' ')) END AS word_count, length(text) AS char_count, substr(sha1(" + B.stripped("text") + "), 1, 16) AS text_key, substr(sha256(lang), 1, 12) AS template_key FROM documents")
def text_stats(spark, sf):
    d = B.table(spark, sf, "documents")
    return B.tidy(d.select("doc_id", T.word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), text_key(F.col("text")).alias("text_key"), template_key(F.col("lang")).alias("template_key")))


@query(f"{_W}, g AS (SELECT category, effort, row_idx FROM t) SELECT category, effort, count(*) AS n FROM g GROUP BY ALL HAVING count(*) < 20")
def small_buckets(spark, sf):
    return L.small_buckets(B.texts(spark, sf), ["category", "effort"], 20)


@query(r"SELECT conv_id, turn, trim(regexp_replace(replace(text, chr(0), ' '), '[\s]+', ' ', 'g')) AS cleaned FROM conversations")
def cleaned_text(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", T.clean(F.col("text")).alias("cleaned"))


@query(r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(url), '[ _-]', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '^-+|-+$', '', 'g'), ''), 'keyword') AS hyphen, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'judge') AS underscore FROM pages")
def slugs(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", hyphen_slug(F.col("url")).alias("hyphen"), underscore_slug(F.col("url")).alias("underscore"))
