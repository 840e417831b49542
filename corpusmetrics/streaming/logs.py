"""An append-only log as a stream: malformed lines are dropped, replayed rows counted once, the rest appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import parsed


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parsed(spark.readStream.text(path), schema)


def once(log: DataFrame, key: Sequence[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once, as long as its replays come within ``lateness``: the state is bounded by the watermark."""
    return log.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(key))


def append(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Exactly once into Parquet; started again with the same checkpoint, it goes on where it stopped."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(log: DataFrame, time: str, width: str, by: Sequence[str], lateness: str = "10 minutes") -> DataFrame:
    return log.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
