"""Task tables: generation, what is still to be done, merging of logs, and a pluggable worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import effort_order

SAMPLE_KEY = ("category", "keyword", "prompt_style", "effort", "sample_index")


def canonical_index(samples: DataFrame) -> DataFrame:
    """row_idx from 0 in the canonical order: category (null as ''), keyword, prompt style, effort tier, sample index.

    Ranks within keywords are offset by counts, so no single task orders all rows.
    """
    part = [F.coalesce("category", F.lit("")).alias("__category"), F.col("keyword").alias("__keyword")]
    s = samples.select("*", *part)
    sizes = s.groupBy("__category", "__keyword").agg(F.count("*").alias("__n"))
    # one row for each keyword
    before = F.sum("__n").over(Window.orderBy("__category", "__keyword").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__category", "__keyword", F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__category", "__keyword").orderBy("prompt_style", effort_order(F.col("effort")), "sample_index")) - 1
    return s.withColumn("__own", own).join(starts, ["__category", "__keyword"]).withColumn("row_idx", F.col("__start") + F.col("__own")).drop("__category", "__keyword", "__own", "__start", "__n")


def task_space(keywords: DataFrame, efforts: Sequence[str], per_group: int) -> DataFrame:
    """All (keyword, effort, sample_index): the product is made by exploding two short literal lists."""
    e = keywords.select("*", F.explode(F.array(*map(F.lit, efforts))).alias("effort"))
    return e.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_group - 1).cast("long"))).alias("sample_index"))


def missing_tasks(tasks: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    return tasks.join(done.select(*key).distinct(), list(key), "left_anti")


def merge_backfill(samples: DataFrame, backfill: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union by key; what stands in ``samples`` wins over ``backfill``."""
    both = samples.withColumn("__src", F.lit(0)).unionByName(backfill.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__src")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__src")


def last_write_wins(log: DataFrame, key: Sequence[str], line: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(line))
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def reuse_cached(new: DataFrame, old: DataFrame, key: Sequence[str], payload: Sequence[str], order: str) -> DataFrame:
    """Rows of ``new`` with the payload of the first row of ``old`` that has their key; others are left out."""
    w = Window.partitionBy(*key).orderBy(order)
    first = old.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*key, *payload)
    return new.join(first, list(key))


def explode_calls(calls: DataFrame, responses: str = "responses", per_call: int | Column = 3) -> DataFrame:
    """One row for each response of a call; sample_index = batch * per_call + position, so per_call is the most responses that a call has."""
    c = calls.select("*", F.posexplode(responses).alias("__pos", "response")).drop(responses)
    return c.withColumn("sample_index", F.col("batch_index") * per_call + F.col("__pos")).drop("__pos")


def run_tasks(tasks: DataFrame, worker: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, concurrency: int) -> DataFrame:
    """Pending tasks through an injected client, on ``concurrency`` partitions; failures come back as rows with an error."""
    return tasks.repartition(concurrency).mapInPandas(worker, schema)


def split_by_status(results: DataFrame, error: str = "error_message") -> tuple[DataFrame, DataFrame]:
    return results.where(F.col(error).isNull()), results.where(F.col(error).isNotNull())


def echo_client(text: str) -> Callable:
    """An offline client that answers every task with its own text."""

    def worker(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(response=b[text], error_message=None)

    return worker
