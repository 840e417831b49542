"""Publishing a table in two phases: parts are written and verified first, then one manifest appears at once.

Readers go by the manifest alone, so an aborted write is invisible and a new version replaces the old one in one
rename.  Parts lie in a folder named after the content; a run that starts again finds those that are complete, writes
the others, and ends with the same manifest.  A dry run says what would be written.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.checks import IntegrityError
from ..operators.fingerprint import SUMS, combined, digest, fingerprints, schema_of

MANIFEST = "manifest.json"


@dataclass
class Manifest:
    """What a published table consists of; it holds no times or random names, so the same content gives the same manifest."""

    schema: str
    rows: int
    fingerprint: str
    cause: str
    parts: list[dict]


class Folder:
    """A folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._system = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return self._system.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file under its name, or nothing: written beside it and renamed."""
        beside = self._at(f".{name}.new")
        stream = self._system.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._at(name).toUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        over[0] = self._hadoop.Options.Rename.OVERWRITE
        context.rename(beside, self._at(name), over)

    def drop(self, name: str) -> None:
        self._system.delete(self._at(name), True)


def manifest_of(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest of a published table, or None while there is none."""
    folder = Folder(spark, path)
    return Manifest(**json.loads(folder.read(MANIFEST))) if folder.has(MANIFEST) else None


def plan(df: DataFrame, key: list[str], parts: int) -> DataFrame:
    """part, rows and the sums of its fingerprint: what would be written.  Rows are dealt by the digest of their key."""
    return fingerprints(dealt(df, key, parts), ["__part"]).withColumnRenamed("__part", "part")


def dealt(df: DataFrame, key: list[str], parts: int) -> DataFrame:
    return df.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))


def publish(df: DataFrame, path: str, key: list[str], parts: int = 64, jobs: int = 4, rows: int | None = None, cause: str = "", dry_run: bool = False, stop=None) -> Manifest:
    """Writes df under ``path`` and returns the manifest; with dry_run nothing is written.

    rows: how many there must be; key: columns that may not repeat, and by which rows are dealt to parts; jobs: parts
    are written in so many jobs, each of which reads ``df`` and is kept once it ended; cause: the fingerprint of what the table was made from (see
    ``cached``); stop: called before each job, may raise.  ``df`` must give the same rows when read again.
    """
    spark, folder = df.sparkSession, Folder(df.sparkSession, path)
    repeated = df.groupBy(*key).count().where("count > 1").limit(1).count()
    if repeated:
        raise IntegrityError(f"rows repeat a key {key}")
    # one row a part
    want = {r["part"]: {"rows": r["rows"], "sums": [r[s] for s in SUMS]} for r in plan(df, key, parts).collect()}
    total = sum(w["rows"] for w in want.values())
    if rows is not None and total != rows:
        raise IntegrityError(f"{total} rows, not {rows}")
    name = digest(schema_of(df), total, [sum(w["sums"][k] for w in want.values()) % (2**61 - 1) for k in range(len(SUMS))])
    home = f"data-{name[:16]}"
    job = lambda part: part * jobs // parts
    listed = [{"path": f"{home}/job-{job(p):04d}/__part={p}", **want[p]} for p in sorted(want)]
    out = Manifest(df.schema.json(), total, name, cause, listed)
    if dry_run:
        return out
    for k in sorted({job(p) for p in want}):
        place, own = f"{home}/job-{k:04d}", [p for p in want if job(p) == k]
        if not folder.has(f"{place}/_SUCCESS"):  # else an earlier run came this far
            if stop is not None:
                stop(k)
            chosen = dealt(df, key, parts).where(F.col("__part").between(min(own), max(own)))
            chosen.repartition(len(own), "__part").write.partitionBy("__part").mode("overwrite").parquet(f"{folder.path}/{place}")
        seen = fingerprints(spark.read.schema(StructType([*df.schema.fields, StructField("__part", IntegerType())])).parquet(f"{folder.path}/{place}"), ["__part"]).collect()
        if {r["__part"]: {"rows": r["rows"], "sums": [r[s] for s in SUMS]} for r in seen} != {p: want[p] for p in own}:
            folder.drop(place)
            raise IntegrityError(f"{place} does not hold what was to be written")
    folder.write(MANIFEST, json.dumps(asdict(out), indent=1))
    return out


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table that the manifest names; raises while none is published."""
    found = manifest_of(spark, path)
    if found is None:
        raise IntegrityError(f"nothing is published at {path}")
    schema = StructType.fromJson(json.loads(found.schema))
    if not found.parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/{p['path']}" for p in found.parts))


def cached(spark: SparkSession, path: str, inputs: dict[str, DataFrame], settings: dict, key: list[str], compute, parts: int = 64) -> DataFrame:
    """The published result of ``compute()`` if it was made from these inputs and settings; else it is made and published."""
    cause = combined(inputs, settings)
    found = manifest_of(spark, path)
    if found is None or found.cause != cause:
        publish(compute(), path, key, parts, cause=cause)
    return published(spark, path)
