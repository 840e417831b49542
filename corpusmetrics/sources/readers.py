"""Readers of JSON lines (plain or gzip), CSV lists and dense matrices."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_blank, stripped
from ..functions.constants import AXES
from ..operators.checks import IntegrityError, invalid_labels, invalid_scores, misaligned, require_empty
from ..operators.selection import positional_join
from ..operators.tasks import canonical_index, merge_backfill
from . import schemas
from .numpy_source import read_numpy


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, partitions: int | None = None) -> DataFrame:
    """Records of a declared schema.  Strict: a malformed line fails the read; else it is dropped.

    gzip files can't be split: pass ``partitions`` to spread what they hold.
    """
    if strict:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        df = parsed(spark.read.text(path), schema)
    return df.repartition(partitions) if partitions else df


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """The well-formed records among lines of text (column value); blank and malformed lines are dropped."""
    record = F.from_json("value", schema + ", _corrupt_record STRING", {"mode": "PERMISSIVE"})
    rows = lines.where(~is_blank(F.col("value"))).select(record.alias("r"))
    return rows.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def samples(spark: SparkSession, path: str | list[str], backfill: str | None = None) -> DataFrame:
    """Validated samples in canonical order (row_idx), backfilled rows included."""
    df = json_lines(spark, path, schemas.SAMPLE)
    if backfill:
        df = merge_backfill(df, json_lines(spark, backfill, schemas.SAMPLE), ["keyword", "prompt_style", "effort", "sample_index"])
    return canonical_index(df)


def pairwise(spark: SparkSession, path: str | list[str], strict: bool = True, validate: bool = True) -> DataFrame:
    """One row a judgment, flat; values that no judgment has raise."""
    df = json_lines(spark, path, schemas.PAIRWISE, strict)
    out = df.select("request.pair.*", "request.order", "request.judge_model", "answer").withColumnsRenamed({"sample_i_index": "i", "sample_j_index": "j", "embedding_distance": "distance"})
    if validate:
        require_empty(invalid_labels(out), "labels, orders or strata that no judgment has")
    return out


def quality(spark: SparkSession, path: str | list[str], strict: bool = True, validate: bool = True) -> DataFrame:
    """One row a judgment, flat; scores beyond 1 to 10 raise."""
    df = json_lines(spark, path, schemas.QUALITY, strict)
    out = df.select("request.target.*", "request.judge_model", "request.idea_text", *(f"scores.{a}" for a in AXES))
    if validate:
        require_empty(invalid_scores(out), "scores beyond 1 to 10")
    return out


def row_keys(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.ROW_KEY).withColumn("category", F.coalesce("category", F.lit("")))


def template(spark: SparkSession, path: str, needed: Sequence[str]) -> dict[str, str]:
    """The texts of a JSON file of prompts; raises where none of them holds a placeholder that is ``needed``."""
    prompts = json.loads(spark.read.text(path, wholetext=True).first()[0])
    missing = [n for n in needed if not any("{" + n + "}" in t for t in prompts.values() if isinstance(t, str))]
    if missing:
        raise IntegrityError(f"{path} lacks placeholders {missing}")
    return prompts


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def keyword_list(spark: SparkSession, path: str) -> DataFrame:
    """keyword, category of a CSV (headers of any case) or of a text file of one keyword a line; blank ones are left out."""
    if path.endswith(".txt"):
        df = spark.read.text(path).select(stripped(F.col("value")).alias("keyword"), F.lit(None).cast("string").alias("category"))
    else:
        raw = spark.read.option("header", True).csv(path)
        raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
        category = stripped(F.col("category")) if "category" in raw.columns else F.lit(None).cast("string")
        df = raw.select(stripped(F.col("keyword")).alias("keyword"), F.nullif(category, F.lit("")).alias("category"))
    return df.where("keyword <> ''")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """row_idx, vec of a NumPy matrix (.npy) on any file system of the session; a partition reads a range of rows."""
    return read_numpy(spark, path)


def facet_archive(spark: SparkSession, path: str) -> DataFrame:
    """facet, keyword, effort, rank, vec of a NumPy archive (.npz) whose entries are named effort|keyword|facet."""
    return read_numpy(spark, path)


def align_archive(records: DataFrame, archive: DataFrame) -> DataFrame:
    """Vectors of an archive joined to records by their rank within (facet, effort, keyword); raises if counts differ."""
    by = ["facet", "effort", "keyword"]
    j = positional_join(records.withColumn("__a", F.lit(True)), archive.withColumn("__b", F.lit(True)), by, ["row_idx"], ["rank"])
    require_empty(j.where("__a is null or __b is null"), "records and vectors differ in number")
    return j.drop("__a", "__b")


def published_matrix(records: DataFrame, keys: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records with their vectors, after row keys were found equal row by row."""
    key = ["category", "keyword", "prompt_style", "effort", "sample_index"]
    own = records.withColumn("category", F.coalesce("category", F.lit("")))
    require_empty(misaligned(own, keys, key), "matrix rows don't belong to the records")
    return records.join(vectors, "row_idx")


def panel_grid(parts: Sequence[tuple[DataFrame | None, str, str]]) -> DataFrame:
    """Vectors of runs x embedders x facets in one table; parts that are None are skipped.  Each part: (rows with idea_model, embedder, facet)."""
    out = None
    for df, embedder, facet in parts:
        if df is None:
            continue
        if len(df.select("idea_model").distinct().take(2)) != 1:
            raise IntegrityError(f"{embedder}/{facet}: a run must have exactly one model")
        rows = df.withColumn("embedder", F.lit(embedder)).withColumn("facet", F.lit(facet))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise IntegrityError("no part of the grid exists")
    return out


def with_reasoning_counts(samples: DataFrame, counts: DataFrame) -> DataFrame:
    """Samples with counted reasoning tokens; raises where a sample has none."""
    key = ["keyword", "effort", "sample_index"]
    out = samples.join(counts.select(*key, "reasoning_tokens"), key, "left")
    require_empty(out.where("reasoning_tokens is null").select(*key), "no reasoning tokens counted")
    return out
