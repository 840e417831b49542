"""Writers: CSV, JSON lines, matrices in long form, merged releases and partitioned lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import IntegrityError, duplicate_keys, require_empty
from ..operators.tasks import SAMPLE_KEY, last_write_wins, merge_backfill


def csv(df: DataFrame, path: str, when_empty: str = "write", single: bool = False, mode: str = "errorifexists") -> bool:
    """Writes with a header; ``when_empty``: write (a header alone), skip or raise.  Whether anything was written."""
    if when_empty != "write" and df.isEmpty():
        if when_empty == "raise":
            raise IntegrityError(f"no rows for {path}")
        return False
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).csv(path)
    return True


def json_lines(df: DataFrame, path: str, append: bool = True, gzip: bool = False) -> None:
    w = df.write.mode("append" if append else "errorifexists")
    (w.option("compression", "gzip") if gzip else w).json(path)


def square_matrix(long: DataFrame, labels: Sequence[str], most: int = 10_000) -> DataFrame:
    """Long form (a, b, distance) as one column a label; only for few labels."""
    if len(labels) > most:
        raise IntegrityError("too many labels for columns; keep the long form")
    return long.groupBy("a").pivot("b", list(labels)).agg(F.first("distance"))


def vectors(df: DataFrame, path: str) -> None:
    """Appends rows (row_idx, vec, ..); readers take the last of each row_idx."""
    df.write.mode("append").parquet(path)


def pending_rows(log: DataFrame, expected: int) -> DataFrame:
    """row_idx of the rows 0 .. expected - 1 that a partial log lacks: what a resumed run has to write."""
    return log.sparkSession.range(expected).withColumnRenamed("id", "row_idx").join(log.select("row_idx").distinct(), "row_idx", "left_anti")


def finalized_vectors(log: DataFrame, expected: int, line: str = "line_no") -> DataFrame:
    """The last row of each row_idx, after all rows 0 .. expected - 1 were found."""
    out = last_write_wins(log, ["row_idx"], line)
    have = out.agg(F.count("*"), F.min("row_idx"), F.max("row_idx")).first()
    if expected and tuple(have) != (expected, 0, expected - 1):
        raise IntegrityError(f"{have[0]} of {expected} rows, {have[1]} .. {have[2]}")
    return out


def release(samples: DataFrame, backfill: DataFrame, vecs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged samples, vectors as float, and row keys: what a release holds."""
    merged = merge_backfill(samples, backfill, [k for k in SAMPLE_KEY if k != "category"])
    keys = merged.select("row_idx", F.coalesce("category", F.lit("")).alias("category"), *SAMPLE_KEY[1:])
    return merged, vecs.withColumn("vec", F.col("vec").cast("array<float>")), keys


def matrix_order(samples: DataFrame, keys: DataFrame) -> DataFrame:
    """Samples in the order of the matrix rows; raises on missing or repeated keys."""
    key = list(SAMPLE_KEY)
    own = samples.withColumn("category", F.coalesce("category", F.lit(""))).drop("row_idx")
    require_empty(duplicate_keys(own, key), "samples repeat a key")
    out = keys.select("row_idx", *key).join(own.withColumn("__there", F.lit(True)), key, "left")
    require_empty(out.where("__there is null").select(*key), "no sample for a matrix row")
    return out.drop("__there")


def masked(records: DataFrame, vecs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """The records that a condition holds for, and their vectors."""
    rows = records.where(keep)
    return rows, vecs.join(rows.select("row_idx"), "row_idx", "left_semi")


def without_keyword(keyword: str, records: DataFrame, vecs: DataFrame, *logs: DataFrame) -> tuple[DataFrame, ...]:
    """Records, vectors and logs without a keyword."""
    other = F.col("keyword") != keyword
    return (*masked(records, vecs, other), *(x.where(other) for x in logs))


def markdown(df: DataFrame, path: str, title: str, order: Sequence[str] = ()) -> None:
    """A small table as a Markdown report: one file."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    top = df.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    body = (df.orderBy(*order) if order else df).select(line.alias("value")).coalesce(1)
    top.union(body).coalesce(1).write.text(path)


def keyword_filters(rows: DataFrame, path: str, expected: dict[str, int]) -> None:
    """One folder of keywords a model, after the counts were found as expected."""
    have = {r[0]: r[1] for r in rows.groupBy("generation_model").agg(F.countDistinct("keyword")).collect()}
    if have != expected:
        raise IntegrityError(f"keywords a model: {have}, expected {expected}")
    rows.select("generation_model", "keyword").distinct().write.partitionBy("generation_model").option("header", True).csv(path)


def pca_coordinates(records: DataFrame, coordinates: DataFrame, path: str) -> None:
    keep = ["keyword", "category", "prompt_style", "effort", "sample_index", "x", "y", "word_count", "output_tokens", "stop_reason", "has_reasoning_block", "idea"]
    rows = records.join(coordinates.select("row_idx", "x", "y"), "row_idx").withColumn("has_reasoning_block", F.col("has_reasoning_block").cast("int"))
    rows.select(*keep).write.option("header", True).csv(path)
