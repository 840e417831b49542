"""Answering tasks with a client that may fail: attempts as keyed state with timers.

Every task is a key.  A failure that may pass away sets a timer, later with each attempt; after the last
attempt, or a failure that will not pass, the task is a dead letter.  A task has one outcome, however often it is
read again.  The state of a task is a few numbers and, while it waits, what was asked.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import is_blank

#: Parts of messages (lower case) whose failures may pass away.
PASSING = ("throttl", "too many requests", "timeout", "temporar", "service unavailable", "modelnotready", "internalserver", "exhausted")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "task string, answer string, error string, attempts int, dead boolean"


def passes(message: str) -> bool:
    low = message.lower()
    return any(part in low for part in PASSING)


def backoff_ms(task: str, attempt: int, first_s: float = 1.0, most_s: float = 30.0, jitter_s: float = 1.0) -> int:
    """Waiting time after the attempt (from 1): doubled each time, plus a jitter that follows from task and attempt, at most ``most_s``."""
    jitter = zlib.crc32(f"{task}:{attempt}".encode()) / 2**32 * jitter_s
    return int(1000 * min(most_s, first_s * 2 ** (attempt - 1) + jitter))


class Attempts(StatefulProcessor):
    """States by task: how often it was tried, whether it has its outcome, what was asked."""

    def __init__(self, client: Callable[[str], str], most: int, first_s: float, most_s: float, jitter_s: float):
        self.client, self.most, self.waits = client, most, (first_s, most_s, jitter_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "attempts int, done boolean, asked string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = [v for pdf in rows for v in pdf["asked"].tolist()]
        if not self.state.exists():
            yield from self._tried(key[0], asked[0], 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, done, asked = self.state.get()
        if not done:
            yield from self._tried(key[0], asked, attempts, timerValues)

    def _tried(self, task: str, asked: str, before: int, timers) -> Iterator[pd.DataFrame]:
        attempts, answer, error = before + 1, None, None
        try:
            answer = self.client(asked)
        except Exception as e:  # whatever the client raises is an outcome
            error = f"{type(e).__name__}: {e}"
        if error is not None and passes(error) and attempts < self.most:
            self.state.update((attempts, False, asked))
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + backoff_ms(task, attempts, *self.waits))
            return
        self.state.update((attempts, True, None))
        yield pd.DataFrame({"task": [task], "answer": [answer], "error": [error], "attempts": [attempts], "dead": [error is not None]})

    def close(self) -> None:
        pass


def with_attempts(tasks: DataFrame, client: Callable[[str], str], most: int = 6, first_s: float = 1.0, most_s: float = 30.0, jitter_s: float = 1.0) -> DataFrame:
    """The outcomes (task, answer, error, attempts, dead) of a stream of tasks (task, asked), each task once.

    client: any function of the text asked; what it raises with a passing message is tried again, ``most`` times in all.
    It may be called again for a task whose micro-batch is repeated; the outcome is written once.
    """
    use_rocksdb(tasks.sparkSession)
    return tasks.groupBy("task").transformWithStateInPandas(Attempts(client, most, first_s, most_s, jitter_s), OUTCOME, "Append", "ProcessingTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need this state store, which keeps state on disk and checkpoints changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def answered(tasks: DataFrame, path: str, checkpoint: str, client: Callable[[str], str], every: str = "1 second", **more) -> StreamingQuery:
    """Outcomes into Parquet, exactly once; started again with the same checkpoint, waiting tasks go on where they were."""
    out = with_attempts(tasks, client, **more)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def dead_letters(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("dead").select("task", "error", "attempts")


def to_repair(records: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key of the records in which one of the fields is null or blank: what has to be made again."""
    blank = F.lit(False)
    for f in fields:
        blank = blank | is_blank(F.col(f))
    return records.where(blank).select(*key)


def repaired(records: DataFrame, made: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The records with the fields of ``made`` (one row a key) where it has all of them and the record lacks one; others stay as they are."""
    blank, whole = F.lit(False), F.lit(True)
    for f in fields:
        blank, whole = blank | is_blank(F.col(f)), whole & ~is_blank(F.col(f"__new_{f}"))
    new = made.select(*key, *(F.col(f).alias(f"__new_{f}") for f in fields))
    take = F.coalesce(blank & whole, F.lit(False))
    joined = records.join(new, key, "left").withColumn("__take", take)
    return joined.select(*(F.when(F.col("__take"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns))
