"""Tables in the folder that driver and executors share, and column checks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in joins and orders: such rows come before all others.
NULL_ID = -(2**63)
#: Sessions and paths of the tables written and not yet dropped.
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all runs on one machine, a temporary one that is then set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="cm-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage ends there, and lost executors do not matter.

    The table goes with ``drop``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    _WRITTEN[path] = spark
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that ``stored`` gave; nothing may read it afterwards."""
    _delete(df.stored_path)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id, text and ``more``, with the types the operators count on; other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions_for(spark: SparkSession, total_bytes: float, each: float = 32e6) -> int:
    """Shuffle partitions so that each gets about ``each`` bytes, and no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total_bytes / each) + 1)
