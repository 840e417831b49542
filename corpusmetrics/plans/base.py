"""Registration of queries with their SQL, and the driver's tables seen as the library's entities.

Vectors: row_idx = vec_id, keyword = label, effort = tier of vec_id % 4, gen = vec_id % 3.
Texts: row_idx = doc_id, keyword = source, category = lang, effort = tier of doc_id // 20 % 4;
facets are the first line that isn't empty, the second, and all others.  Tokens: events by user.  Judgments
are derived from distances of pairs, quality scores from labels, both by fixed arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.columns import rounded
from ..functions.constants import EFFORTS, LABELS, WHITE
from ..operators import diversity as D
from ..operators import selection as S
from ..registry import ORACLE, QUERIES


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums of another order compare equal; counts as long."""
    kinds = dict(df.dtypes)
    return df.select(*(rounded(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") or kinds[c].startswith("decimal") else F.col(c) for c in df.columns))


def tier(c) -> F.Column:
    return F.element_at(F.array(*map(F.lit, EFFORTS)), (F.pmod(c, F.lit(4)) + 1).cast("int"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_idx"), F.col("label").cast("string").alias("keyword"), tier(F.col("vec_id")).alias("effort"), F.concat(F.lit("g"), F.col("vec_id") % 3).alias("gen"), V.doubles(F.col("embedding")).alias("vec"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rest = F.when(F.size(lines) > 2, F.array_join(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))
    facet = [F.coalesce(c, F.lit("")) for c in (F.get(lines, 0), F.get(lines, 1), rest)]
    return d.select(F.col("doc_id").alias("row_idx"), F.col("source").alias("keyword"), F.col("lang").alias("category"), tier(F.floor(F.col("doc_id") / 20)).alias("effort"), F.col("text").alias("idea"), *(c.alias(n) for n, c in zip(("purpose", "mechanism", "evaluation"), facet, strict=True)))


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("sample_index"),
        F.col("user_id").cast("string").alias("keyword"),
        F.col("event_type").alias("prompt"),
        tier(F.col("event_id")).alias("effort"),
        (F.col("event_id") % 50 + 1).alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("visible"),
        k.alias("reasoning_tokens"),
        "value",
    ).select("*", (F.col("visible") + F.col("reasoning_tokens")).alias("output_tokens"), (F.col("input_tokens") + F.col("visible") + F.col("reasoning_tokens")).alias("total_tokens"))


def label(d, shift=0) -> F.Column:
    n = F.when(d >= 1.1, 0).when(d >= 1.0, 1).when(d >= 0.9, 2).otherwise(3)
    return F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod(n + shift, F.lit(4)) + 1).cast("int"))


def stratified(spark: SparkSession, sf: str, m: int = 5) -> DataFrame:
    return S.stratified_pairs(samples(spark, sf), D.GROUP, m, short="all")


def judged(spark: SparkSession, sf: str, judge: int = 0, pairs: DataFrame | None = None) -> DataFrame:
    """Labels of the stratified pairs in both orders; another judge moves every fourth label by one."""
    p = stratified(spark, sf) if pairs is None else pairs
    p = p.withColumn("order", F.explode(F.array(F.lit("ab"), F.lit("ba")))).withColumn("distance", F.round("distance", 9))
    moved = F.when((F.col("order") == "ba") & ((F.col("i") + F.col("j")) % 5 == 0), 1).otherwise(0)
    if judge:
        moved = moved + F.when((F.col("i") * 7 + F.col("j")) % 4 == 0, 1).otherwise(0)
    return p.withColumn("answer", label(F.col("distance"), moved))


def quality(spark: SparkSession, sf: str, judge: int = 0) -> DataFrame:
    """Scores 1..10 of labelled texts; another judge moves them by -1, 0 or 1."""
    t = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    q = table(spark, sf, "labels").join(t, "doc_id")
    by = F.col("doc_id") % 3 - 1 if judge else F.lit(0)
    clip = lambda c: F.greatest(F.lit(1), F.least(F.lit(10), c)).cast("int")
    return q.select(
        F.col("doc_id").alias("row_idx"),
        F.col("source").alias("keyword"),
        tier(F.floor(F.col("doc_id") / 20)).alias("effort"),
        clip(1 + (F.col("doc_id") * 7 + F.col("quality") * 3) % 10 + by).alias("originality"),
        clip(1 + (F.col("doc_id") * 3 + F.col("toxic") * 5) % 10 + by).alias("feasibility"),
        clip(1 + F.col("n_chars") % 10 + by).alias("clarity"),
        "quality",
        "toxic",
    )


def stripped(text: str) -> str:
    """Text without white space at either end, in SQL."""
    return f"regexp_replace({text}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


EMB = """
v0 AS (SELECT vec_id AS row_idx, CAST(label AS VARCHAR) AS keyword, ['none', 'low', 'medium', 'high'][vec_id % 4 + 1] AS effort,
       'g' || CAST(vec_id % 3 AS VARCHAR) AS gen, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT *, list_transform(v, lambda x: x / CASE WHEN l = 0 THEN 1 ELSE l END) AS u FROM (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM v0))"""
PAIRS = (
    EMB
    + """,
pairs AS (SELECT a.keyword, a.effort, a.row_idx AS i, b.row_idx AS j, least(2, greatest(0, 1 - list_inner_product(a.u, b.u))) AS distance
          FROM e a JOIN e b ON a.keyword = b.keyword AND a.effort = b.effort AND a.row_idx < b.row_idx)"""
)
COORDS = (
    EMB
    + """,
c AS (SELECT row_idx, keyword, effort, gen, unnest(v) AS x, unnest(u) AS y, generate_subscripts(v, 1) AS k FROM e)"""
)
STRATIFIED = (
    PAIRS
    + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY keyword, effort ORDER BY round(distance, 12) DESC, i, j) AS far,
              row_number() OVER (PARTITION BY keyword, effort ORDER BY round(distance, 12), i, j) AS near,
              count(*) OVER (PARTITION BY keyword, effort) AS size FROM pairs),
strat AS (SELECT keyword, effort, i, j, distance, 'top' AS stratum, far AS rank FROM rk WHERE far <= 5
          UNION ALL SELECT keyword, effort, i, j, distance, 'middle', near - greatest(0, (size - 5) // 2) FROM rk
            WHERE near - greatest(0, (size - 5) // 2) BETWEEN 1 AND 5
          UNION ALL SELECT keyword, effort, i, j, distance, 'bottom', near FROM rk WHERE near <= 5)"""
)
_LABEL = "['A', 'B', 'C', 'D'][((CASE WHEN distance >= 1.1 THEN 0 WHEN distance >= 1.0 THEN 1 WHEN distance >= 0.9 THEN 2 ELSE 3 END) + {}) % 4 + 1]"
_MOVED = "(CASE WHEN \"order\" = 'ba' AND (i + j) % 5 = 0 THEN 1 ELSE 0 END)"
JUDGED = (
    STRATIFIED
    + f""",
ordered AS (SELECT keyword, effort, i, j, round(distance, 9) AS distance, stratum, rank, unnest(['ab', 'ba']) AS "order" FROM strat),
judged AS (SELECT *, {_LABEL.format(_MOVED)} AS answer FROM ordered),
judged2 AS (SELECT *, {_LABEL.format(_MOVED + " + (CASE WHEN (i * 7 + j) % 4 = 0 THEN 1 ELSE 0 END)")} AS answer FROM ordered)"""
)
TEXTS = """
t0 AS (SELECT doc_id AS row_idx, source AS keyword, lang AS category, ['none', 'low', 'medium', 'high'][doc_id // 20 % 4 + 1] AS effort, text AS idea,
              list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents),
t AS (SELECT *, coalesce(ls[1], '') AS purpose, coalesce(ls[2], '') AS mechanism, coalesce(array_to_string(ls[3:], chr(10)), '') AS evaluation FROM t0)"""
TOKENS = """
k0 AS (SELECT event_id AS sample_index, CAST(user_id AS VARCHAR) AS keyword, event_type AS prompt, ['none', 'low', 'medium', 'high'][event_id % 4 + 1] AS effort,
              event_id % 50 + 1 AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS visible, CAST(json_extract_string(props, '$.k') AS BIGINT) AS reasoning_tokens, value FROM events),
k AS (SELECT *, visible + reasoning_tokens AS output_tokens, input_tokens + visible + reasoning_tokens AS total_tokens FROM k0)"""


def _scores(name: str, by: str) -> str:
    return f"""
{name} AS (SELECT doc_id AS row_idx, source AS keyword, ['none', 'low', 'medium', 'high'][doc_id // 20 % 4 + 1] AS effort,
    greatest(1, least(10, 1 + (doc_id * 7 + quality * 3) % 10 + {by})) AS originality,
    greatest(1, least(10, 1 + (doc_id * 3 + toxic * 5) % 10 + {by})) AS feasibility,
    greatest(1, least(10, 1 + n_chars % 10 + {by})) AS clarity, quality, toxic FROM labels JOIN documents USING (doc_id))"""


SCORES = _scores("q", "0") + "," + _scores("q2", "(doc_id % 3 - 1)")


def _mix(x: str, name: str) -> str:
    """Columns name1 to name5: the 32-bit finaliser of x, step by step."""
    return (
        f"xor({x}, {x} >> 16) AS {name}1, ({name}1 * 2246822507) % 4294967296 AS {name}2, xor({name}2, {name}2 >> 13) AS {name}3, "
        f"({name}3 * 3266489909) % 4294967296 AS {name}4, xor({name}4, {name}4 >> 16) AS {name}5"
    )


def drawn(rows: str, by: Sequence[str], order: str, n_boot: int, seed: int, name: str) -> str:
    """A common table ``name``: the rows that each draw takes (by, draw and the columns of ``rows``)."""
    keys = ", ".join(by)
    return f"""
{name}_p AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS UBIGINT) AS place, CAST(count(*) OVER (PARTITION BY {keys}) AS UBIGINT) AS places FROM {rows}),
{name}_d AS MATERIALIZED (SELECT CAST(i AS UBIGINT) AS draw, ({seed} + draw * 2654435769) % 4294967296 AS a0, {_mix('a0', 'a')} FROM generate_series(0, {n_boot - 1}) g(i)),
{name} AS (SELECT v.* EXCLUDE (place), k.draw FROM (
    SELECT {keys}, draw, places, (place + a5) % 4294967296 AS b0, {_mix('b0', 'b')}, (b5 + a5) % 4294967296 AS c0, {_mix('c0', 'c')}, (c5 * places) >> 32 AS at FROM {name}_p, {name}_d) k
    JOIN {name}_p v ON {' AND '.join(f'k.{c} IS NOT DISTINCT FROM v.{c}' for c in by)} AND k.at = v.place)"""


def boot_mean(rows: str, by: Sequence[str], value: str, n_boot: int = 1000, digits: int = 6) -> str:
    """The query over a table ``rows`` that bootstrap_mean_ci answers; after WITH ..., rows."""
    keys = ", ".join(by)
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM e.{c}" for c in by)
    return f""", {drawn(f"(SELECT * FROM {rows} WHERE {value} IS NOT NULL)", by, value, n_boot, 42, "drawn")},
dm AS (SELECT {keys}, draw, avg({value}) AS m FROM drawn GROUP BY ALL),
ends AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM dm GROUP BY ALL)
SELECT {', '.join(f's.{c}' for c in by)}, s.n, {r('s.m', digits)} AS mean, {r('lo', digits)} AS ci_low, {r('hi', digits)} AS ci_high
FROM (SELECT {keys}, count({value}) AS n, avg({value}) AS m FROM {rows} GROUP BY ALL) s LEFT JOIN ends e ON {same}"""


def boot_pearson(rows: str, by: Sequence[str], x: str, y: str, n_boot: int = 1000, digits: int = 6) -> str:
    """The query over a table ``rows`` that the guarded bootstrap_pearson_ci answers; after WITH ..., rows."""
    keys = ", ".join(by)
    same = " AND ".join(f"s.{c} IS NOT DISTINCT FROM e.{c}" for c in by)
    own = f"(SELECT * FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f""", {drawn(own, by, f"{x}, {y}", n_boot, 42, "drawn")},
whole AS (SELECT {keys}, count(*) AS n, var_pop({x}) AS vx, var_pop({y}) AS vy, CASE WHEN sqrt(vx) * sqrt(vy) > 1e-12 THEN corr({x}, {y}) END AS r FROM {own} GROUP BY ALL),
dm AS (SELECT {', '.join(f's.{c}' for c in by)}, draw, CASE WHEN var_pop({x}) > 1e-12 * any_value(s.vx) AND var_pop({y}) > 1e-12 * any_value(s.vy) THEN corr({x}, {y}) END AS b
       FROM drawn e JOIN whole s ON {same} GROUP BY ALL),
ends AS (SELECT {keys}, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM dm GROUP BY ALL)
SELECT {', '.join(f's.{c}' for c in by)}, s.n, {r('CASE WHEN s.n >= 3 THEN s.r END', digits)} AS r, {r('CASE WHEN s.n >= 3 THEN lo END', digits)} AS ci_low, {r('CASE WHEN s.n >= 3 THEN hi END', digits)} AS ci_high
FROM whole s LEFT JOIN ends e ON {same}"""
