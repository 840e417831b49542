"""Fingerprints of tables that do not depend on the order or the partitioning of rows, and merge.

Every row has a 240-bit digest of its named values, nulls and types included; digests are added in four parts modulo
a prime.  Sums commute, so a fingerprint is one aggregation with partial sums, and the fingerprints of
parts add up to that of the whole.  Equal rows count as often as they stand there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Mersenne prime below 2**61, and parts of a digest (15 hexadecimal digits each).
PRIME, PARTS = 2**61 - 1, 4
SUMS = tuple(f"s{k}" for k in range(PARTS))


def _ordered(c: Column, kind: T.DataType) -> Column:
    """The value with maps as sorted entries, at any depth."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_ordered(e["key"], kind.keyType).alias("key"), _ordered(e["value"], kind.valueType).alias("value"))
        keys = F.array_sort(F.transform(F.map_entries(c), entry), lambda a, b: F.when(F.to_json(F.struct(a["key"])) < F.to_json(F.struct(b["key"])), -1).otherwise(1))
        return keys
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_ordered(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def schema_of(df: DataFrame) -> str:
    """Names and types in the order of names; whether nulls are allowed does not count."""
    return json.dumps(sorted((f.name, f.dataType.simpleString()) for f in df.schema))


def row_digest(df: DataFrame) -> Column:
    fields = sorted(df.schema, key=lambda f: f.name)
    return F.sha2(F.to_json(F.struct(*(_ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"}), 256)


def fingerprints(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, rows and the sums s0 to s3 over the other columns, of each part that ``by`` names."""
    # sums of 60-bit numbers stay below 38 digits for 10**19 rows
    part = lambda k: F.pmod(F.sum(F.conv(F.substring("__digest", 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(PRIME)).cast("long")
    return df.withColumn("__digest", row_digest(df.drop(*by))).groupBy(*by).agg(F.count("*").alias("rows"), *(part(k).alias(s) for k, s in enumerate(SUMS)))


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fingerprints of unions of parts from those of the parts."""
    return parts.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.pmod(F.sum(F.col(s).cast("decimal(38,0)")), F.lit(PRIME)).cast("long").alias(s) for s in SUMS))


def digest(schema: str, rows: int, sums: Sequence[int]) -> str:
    return hashlib.sha256(json.dumps([schema, rows, [s or 0 for s in sums]]).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """One name for the content of a table: equal for the same rows in any order, else different."""
    row = fingerprints(df).first()
    return digest(schema_of(df), row["rows"], [row[s] for s in SUMS])


def combined(inputs: dict[str, DataFrame], settings: dict | None = None) -> str:
    """One name for all that a result depends on: its input tables and its settings."""
    known = {name: fingerprint(df) for name, df in sorted(inputs.items())}
    return hashlib.sha256(json.dumps([known, settings or {}], sort_keys=True).encode()).hexdigest()
