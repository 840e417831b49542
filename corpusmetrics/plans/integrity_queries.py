"""Queries on keys, task lists, logs and completeness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import effort_order, group_field, is_blank
from ..operators import checks as C
from ..operators import quality as Q
from ..operators import selection as S
from ..operators import tasks as K
from ..operators import tokens as T
from ..operators.diversity import ordered_by_effort
from . import base as B
from .base import query, r

_E = "['none', 'low', 'medium', 'high']"


@query(f"WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS keyword, e AS effort, s AS sample_index FROM nation, unnest({_E}) AS x(e), generate_series(0, 9) AS y(s)), d AS (SELECT DISTINCT CAST(user_id % 25 AS VARCHAR) AS keyword, {_E}[event_id % 4 + 1] AS effort, event_id % 7 AS sample_index FROM events) SELECT keyword, effort, sample_index FROM t ANTI JOIN d USING (keyword, effort, sample_index)")
def missing_tasks(spark, sf):
    keywords = B.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("keyword"))
    done = B.token_rows(spark, sf).select((F.col("keyword").cast("long") % 25).cast("string").alias("keyword"), "effort", (F.col("sample_index") % 7).alias("sample_index"))
    return K.missing_tasks(K.task_space(keywords, ["none", "low", "medium", "high"], 10), done, ["keyword", "effort", "sample_index"])


@query("WITH u AS (SELECT doc_id, 'quality' AS origin, 0 AS src FROM labels UNION ALL SELECT doc_id, 'document', 1 FROM documents), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src) AS rn FROM u) SELECT doc_id, origin FROM x WHERE rn = 1")
def merge_backfill(spark, sf):
    a = B.table(spark, sf, "labels").select("doc_id", F.lit("quality").alias("origin"))
    b = B.table(spark, sf, "documents").select("doc_id", F.lit("document").alias("origin"))
    return K.merge_backfill(a, b, ["doc_id"])


@query("WITH x AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM x WHERE rn = 1")
def last_write_wins(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return K.last_write_wins(e, ["user_id", "event_type"], "event_id")


@query("WITH x AS (SELECT n_nationkey, n_name FROM nation), y AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) SELECT n_nationkey, n_name, c_name FROM x JOIN y ON c_nationkey = n_nationkey AND rn = 1")
def cache_reuse(spark, sf):
    old = B.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return K.reuse_cached(B.table(spark, sf, "nation").select("n_nationkey", "n_name"), old, ["n_nationkey"], ["c_name"], "c_custkey")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return C.duplicate_keys(B.table(spark, sf, "documents"), ["text"])


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def key_set_diff(spark, sf):
    return C.key_set_diff(B.table(spark, sf, "labels"), B.table(spark, sf, "documents"), ["doc_id"])


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), c AS (SELECT n, count(*) AS c FROM s GROUP BY n), m AS (SELECT n AS expected FROM c ORDER BY c.c DESC, n DESC LIMIT 1) SELECT source, n, expected FROM s, m WHERE n <> expected")
def uniform_counts(spark, sf):
    return C.uneven_groups(B.table(spark, sf, "documents"), ["source"])


@query("WITH a AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS row_idx FROM conversations), b AS (SELECT conv_id, CASE WHEN conv_id % 10 = 3 THEN turn + 1 ELSE turn END AS turn, row_idx FROM a) SELECT a.row_idx FROM a JOIN b USING (row_idx) WHERE a.turn <> b.turn")
def row_alignment(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.orderBy("conv_id", "turn")).cast("long").alias("row_idx"))
    keys = c.withColumn("turn", F.when(F.col("conv_id") % 10 == 3, F.col("turn") + 1).otherwise(F.col("turn")))
    return C.misaligned(c, keys, ["conv_id", "turn"]).select("row_idx")


@query("""WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS keyword, turn AS sample_index FROM conversations), k AS (SELECT CAST(doc_id AS VARCHAR) AS keyword FROM documents), g AS (SELECT keyword, count(*) AS n FROM s GROUP BY keyword)
SELECT 'duplicates' AS "check", count(*) AS violations FROM (SELECT 1 FROM s GROUP BY keyword, sample_index HAVING count(*) > 1) UNION ALL SELECT 'missing_keywords', count(DISTINCT keyword) FROM k ANTI JOIN s USING (keyword)
UNION ALL SELECT 'unknown_keywords', count(DISTINCT keyword) FROM s ANTI JOIN k USING (keyword) UNION ALL SELECT 'wrong_counts', count(*) FROM g WHERE n <> 4
UNION ALL SELECT 'total_gap', abs((SELECT count(*) FROM s) - (SELECT count(DISTINCT keyword) * 4 FROM k))""")
def completeness(spark, sf):
    s = B.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("keyword"), F.col("turn").alias("sample_index"))
    return C.completeness(s, B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("keyword")), 4)


@query(f"SELECT n_success, n_error, {r('n_success / (n_success + n_error)')} AS success_rate FROM (SELECT count(*) FILTER (event_type <> 'error') AS n_success, count(*) FILTER (event_type = 'error') AS n_error FROM events)")
def manifest_totals(spark, sf):
    e = B.table(spark, sf, "events")
    return B.tidy(C.manifest_totals(e.where("event_type <> 'error'"), e.where("event_type = 'error'")))


@query("WITH g AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) SELECT CAST(sum(n) AS BIGINT) AS n_attempted FROM g")
def attempted_samples(spark, sf):
    return T.attempted(B.table(spark, sf, "conversations"), ["conv_id"], "turn")


@query(f"WITH d AS (SELECT doc_id, lang AS category, source AS keyword, doc_id % 4 AS e FROM documents) SELECT doc_id, row_number() OVER (ORDER BY category, keyword, 'structured', e, doc_id) - 1 AS row_idx, {_E}[e + 1] AS effort FROM d")
def canonical_order(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("category"), F.col("source").alias("keyword"), F.lit("structured").alias("prompt_style"), B.tier(F.col("doc_id")).alias("effort"), F.col("doc_id").alias("sample_index"))
    return K.canonical_index(d).select("doc_id", "row_idx", "effort")


@query("SELECT DISTINCT source AS keyword, lang AS category FROM documents")
def distinct_keywords(spark, sf):
    return B.table(spark, sf, "documents").select(F.col("source").alias("keyword"), F.col("lang").alias("category")).distinct()


@query("SELECT d.doc_id, d.source FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0) q USING (doc_id)")
def keyword_semi_filter(spark, sf):
    bad = B.table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return B.table(spark, sf, "documents").select("doc_id", "source").join(bad, "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE NOT (source = 'src3' AND lang = 'en')")
def keyword_exclusion(spark, sf):
    excluded = spark.createDataFrame([("src3", "en")], "source string, lang string")
    # a literal list
    return B.table(spark, sf, "documents").join(F.broadcast(excluded), ["source", "lang"], "left_anti").select("doc_id", "source")


@query(f"WITH x AS (SELECT event_id, event_type, value, {_E}[event_id % 4 + 1] AS effort, event_id // 4 AS b FROM events) SELECT event_type, effort, count(*) AS n, CAST(list_position({_E}, effort) - 1 AS BIGINT) AS effort_order FROM x GROUP BY ALL")
def effort_ordering(spark, sf):
    k = B.token_rows(spark, sf).groupBy(F.col("prompt").alias("event_type"), "effort").agg(F.count("*").alias("n"))
    return ordered_by_effort(k.withColumn("effort_order", effort_order(F.col("effort")).cast("long")), "event_type")


@query("SELECT conv_id AS batch_index, turn, conv_id * (SELECT greatest(3, max(n)) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)) + row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS sample_index, text AS response FROM conversations")
def call_explosion(spark, sf):
    c = B.table(spark, sf, "conversations")
    calls = c.groupBy(F.col("conv_id").alias("batch_index")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("responses"))
    # one number for all calls: as many places as the longest has, three at least
    longest = c.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.greatest(F.lit(3), F.coalesce(F.max("n"), F.lit(0))).alias("per_call"))
    out = K.explode_calls(calls.crossJoin(F.broadcast(longest)), per_call=F.col("per_call"))
    return out.select("batch_index", F.col("response.turn").cast("long").alias("turn"), F.col("sample_index").cast("long").alias("sample_index"), F.col("response.text").alias("response"))


@query("WITH x AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM documents), y AS (SELECT l.doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY l.doc_id DESC) AS rk FROM labels l JOIN documents USING (doc_id)) SELECT coalesce(x.lang, y.lang) AS lang, x.doc_id, y.doc_id AS other_id FROM x FULL JOIN y ON x.lang = y.lang AND x.rk = y.rk")
def positional_alignment(spark, sf):
    d = B.table(spark, sf, "documents").select("lang", "doc_id")
    q = B.table(spark, sf, "labels").join(d, "doc_id").select("lang", F.col("doc_id").alias("other_id"))
    return S.positional_join(d, q, ["lang"], ["doc_id"], [F.desc("other_id")])


@query(f"SELECT lang, count(*) AS n, count(*) FILTER ({B.stripped("coalesce(text, '')")} = '') AS n_blank FROM documents GROUP BY lang")
def blank_fields(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("text"))).alias("n_blank"))


@query("SELECT coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), source) AS grp, count(*) AS n FROM documents GROUP BY ALL")
def group_inference(spark, sf):
    d = B.table(spark, sf, "documents").withColumn("category", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")))
    return d.groupBy(group_field(F.col("category"), F.col("source")).alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_difference(spark, sf):
    q = B.table(spark, sf, "labels")
    return q.select("doc_id").exceptAll(q.where("toxic = 1").select("doc_id"))


@query("SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def set_intersection(spark, sf):
    return B.table(spark, sf, "labels").select("doc_id").intersect(B.table(spark, sf, "embeddings").select("vec_id"))


@query("SELECT doc_id, 'quality' AS axis, CAST(quality AS DOUBLE) AS score FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels")
def unpivot_axes(spark, sf):
    q = B.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return Q.unpivot_axes(q, ["doc_id"], ["quality", "toxic"])
