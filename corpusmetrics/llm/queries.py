"""The query opN_<name> of each operator, with the columns its contract names, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_extract import html_extract
from .jaccard_join import jaccard_join
from .lm_score import lm_score
from .merkle_manifest import merkle_manifest
from .packing import best_fit_packing
from .pieces import encode_digests
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .url_filter import SUFFIXES, url_filter
from .window_dedup import window_dedup

#: Where the vocabulary files of the public tokenizers are, by name; None: the installed package says.
TOKENIZERS: dict[str, str] = {}


def tokenizer(name: str) -> str:
    if name in TOKENIZERS:
        return TOKENIZERS[name]
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), crc_mod(10) != 0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_filter(table(spark, sf_dir, "pages"), outcomes)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup(table(spark, sf_dir, "documents"), digest=True)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(4) != 2)
    held_out = F.coalesce(crc_mod(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "flagged")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), crc_mod(2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


QUERIES = {q.__name__: q for q in (op1_exact_dedup, op2_lm_score, op3_url_filter, op4_sentencepiece, op5_embedding_dedup, op6_best_fit_packing, op7_window_dedup, op8_toxicity, op9_suffix_dedup, op10_jaccard_join, op11_merkle_manifest, op12_hard_negatives, op13_html_extract)}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""

_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)
OP3_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS tail FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(tail, '^([^/?#]*)', 1), {AZ}), '') AS host,
             coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
l AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(1 - quality) AS DOUBLE) AS bad
      FROM p JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY host),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS a FROM p),
names AS (SELECT host, CASE WHEN two IN ({_SUFFIXES}) THEN array_to_string(a[-3:], '.') ELSE two END AS domain, CASE WHEN two IN ({_SUFFIXES}) THEN two ELSE a[-1] END AS suffix
          FROM (SELECT *, array_to_string(a[-2:], '.') AS two FROM parts)),
h AS (SELECT * FROM l JOIN names USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
units AS (SELECT 'h' AS level, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
mom AS (SELECT level, sum(bad) / sum(n) AS m, (sum(bad) + 1) / (sum(n) + 2) AS m_all, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS ss, count(*) - 1.0 AS df,
               sum(n) - sum(n * n) / sum(n) AS w FROM units GROUP BY level),
rho AS (SELECT level, m_all AS m, (ss / nullif(m * (1 - m), 0) - df) / nullif(w - df, 0) AS r FROM mom),
k AS (SELECT level, m, 1 / least(0.5, greatest(0.01, coalesce(r, 0.1))) - 1 AS k FROM rho),
one AS (SELECT coalesce((SELECT m FROM k WHERE level = 's'), 0.5) AS m, coalesce((SELECT k FROM k WHERE level = 's'), 9) AS ks,
               coalesce((SELECT k FROM k WHERE level = 'd'), 9) AS kd, coalesce((SELECT k FROM k WHERE level = 'h'), 9) AS kh),
a AS (SELECT names.host, coalesce(h.n, 0) AS nh, coalesce(h.bad, 0) AS bh, coalesce(d.n, 0) AS nd, coalesce(d.bad, 0) AS bd,
             coalesce(s.n, 0) AS ns, coalesce(s.bad, 0) AS bs
      FROM names LEFT JOIN h USING (host) LEFT JOIN d ON names.domain = d.domain LEFT JOIN s ON names.suffix = s.suffix),
post AS (SELECT host, bh + kh * ((bd + kd * ((bs + ks * m) / (ns + ks))) / (nd + kd)) AS al, nh + kh AS t FROM a, one),
earned AS (SELECT host, CASE WHEN al / t - 1.645 * sqrt(al * (t - al) / (t * t * (t + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS e FROM post),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE e END AS verdict
FROM ruled LEFT JOIN earned USING (host)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + ", {}))"
_TEXT = _FIELD.format("text")
#: Whether crc32 of the decimal doc_id is even: bit by bit, with the reversed polynomial 0xEDB88320.
_EVEN = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: list_transform(range(0, 8), lambda b: (ascii(c) >> b) & 1)))), lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384)) & 1 = 1"""
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, leaf, CASE WHEN even THEN changed ELSE leaf END AS folded, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT doc_id, source, {_LEAF.format(_TEXT)} AS leaf, {_LEAF.format(_TEXT.replace("text", "replace(text, chr(10), '')"))} AS changed, coalesce({_EVEN}, false) AS even FROM documents)),
nodes AS (
    SELECT 0 AS level, source, place, n, leaf AS h FROM leaves
    UNION ALL
    SELECT level + 1, source, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY level, source, place // 3),
subroots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
outer_nodes AS (
    SELECT 0 AS level, place, n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM outer_nodes WHERE n > 1 GROUP BY level, place // 3),
sides AS (
    SELECT source, level, place, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM nodes WHERE n > 1 WINDOW r AS (PARTITION BY source, level, place // 3 ORDER BY place)),
outer_sides AS (
    SELECT level, place, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM outer_nodes WHERE n > 1 WINDOW r AS (PARTITION BY level, place // 3 ORDER BY place)),
inner_fold AS (
    SELECT 0 AS level, source, doc_id, leaf, folded AS cur, '' AS proof, place AS own, place FROM leaves
    UNION ALL
    SELECT f.level + 1, f.source, doc_id, leaf, sha256(concat(l, cur, r)), concat(proof, l, r), own, f.place // 3
    FROM inner_fold f JOIN sides s ON f.source IS NOT DISTINCT FROM s.source AND f.level = s.level AND f.place = s.place),
inner_done AS (
    SELECT doc_id, leaf, cur, proof, s.subroot, s.place
    FROM (SELECT *, max(level) OVER (PARTITION BY source) AS last FROM inner_fold) f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE level = last),
outer_fold AS (
    SELECT 0 AS level, *, row_number() OVER () AS id FROM inner_done
    UNION ALL
    SELECT f.level + 1, doc_id, leaf, sha256(concat(l, cur, r)), concat(proof, l, r), subroot, f.place // 3, id FROM outer_fold f JOIN outer_sides s ON f.level = s.level AND f.place = s.place)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM (SELECT *, max(level) OVER () AS last FROM outer_fold), (SELECT h AS root FROM outer_nodes WHERE n = 1) WHERE level = last
"""

OP12_SQL = """
WITH q AS (
    SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (
    SELECT a.vec_id AS anchor_id, a.r AS anchor, b.vec_id AS id, b.r AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
p AS (SELECT anchor, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, place ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

#: The pages of the tables have one article element, of h1 and p blocks, and two references; for such pages SQL can say the same.
_BLOCK = r"regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace({_BLOCK}, '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"
OP13_SQL = rf"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
    SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(?:p|h1)>'),
        lambda b: trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text FROM pages)
"""

SQL = {"op1_exact_dedup": OP1_SQL, "op3_url_filter": OP3_SQL, "op11_merkle_manifest": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_html_extract": OP13_SQL}
