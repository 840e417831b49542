"""Exact deduplication by content-defined chunk recipes.

Each text (A-Z lower-cased, null as empty) is cut where a gear hash of its last 32
bytes meets a mask, so equal passages get equal chunks wherever they stand.  Chunks
are deduplicated to identifiers (128-bit digests), and the identifiers are verified:
every distinct chunk travels once, to where all contents of its digest meet.  Should
a digest stand for two contents, the recipes use the content itself in its place.
Documents are then compared by their ordered identifier lists; whole texts never move.
Groups are counted by (recipe, salt) first and met by (recipe, salt) again, so that a recipe
which a third of all rows share is the work of many tasks.

Defined results: a null text equals an empty one; rows whose doc_id is null count in
their group, and one stays only if the whole group has null ids; repeated rows (same
doc_id, equal texts) are all marked like their doc_id, which is how ties end; a very long
text is as many chunks as it needs, and its recipe has 16 bytes for each; an empty table
gives an empty result; columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import NULL_ID, stored, texts_of

#: A chunk ends where the top MASK_BITS of the gear hash are zero (1 KiB on average), or after LONGEST bytes.
MASK_BITS, LONGEST, WINDOW = 10, 16_384, 32
#: Clashing digests are held by every task; with more of them (a 128-bit digest has none in practice), digests are made longer.
MOST_CLASHES, LONGEST_DIGEST = 100_000, 64
#: Tasks that share the rows of one recipe.
SALTS = 128

_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """End bytes of all chunks of the texts that lie at ``off`` in ``data``."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    cuts = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    owner = np.searchsorted(off, cuts - 1, "right") - 1
    cuts = cuts[cuts - off[owner] >= WINDOW]  # the hash there saw only bytes of its own text
    ends = np.unique(np.concatenate([cuts, off[1:][np.diff(off) > 0]]))
    sizes = np.diff(np.concatenate([[0], ends]))
    if len(sizes) and sizes.max() > LONGEST:
        starts = ends - sizes
        more = -(-sizes // LONGEST) - 1
        inner = tx.ragged(np.ones(len(ends), np.int64), more)
        ends = np.unique(np.concatenate([ends, np.repeat(starts, more) + inner * LONGEST]))
    return ends


def _chunks(col, digest_bytes: int) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, list[bytes]]]:
    for i, j, data, off in tx.slices(tx.column(col)):
        low = tx.LOWER[data]
        buf = low.tobytes()
        ends = chunk_ends(low, off)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        digests = [hashlib.blake2b(buf[a:b], digest_size=digest_bytes).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        yield i, j, buf, off, np.stack([starts, ends]), digests


def _recipes(digest_bytes: int, clashes: frozenset):
    def run(batches):
        for batch in tx.small(batches):
            recipes, shas = [], []
            for i, j, buf, off, spans, digests in _chunks(batch.column("text"), digest_bytes):
                if clashes:
                    digests = [d + (b - a).to_bytes(8, "big") + buf[a:b] if d in clashes else d for (a, b), d in zip(spans.T.tolist(), digests, strict=True)]
                first = np.searchsorted(spans[0], off).tolist()
                for k in range(j - i):
                    recipes.append(b"".join(digests[first[k] : first[k + 1]]))
                    shas.append(hashlib.sha256(buf[off[k] : off[k + 1]]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(recipes, pa.binary()), pa.array(shas, pa.string())], names=["doc_id", "copy", "recipe", "text_sha256"])

    return run


def _contents(digest_bytes: int):
    def run(batches):
        for batch in tx.small(batches):
            for _, _, buf, _, spans, digests in _chunks(batch.column("text"), digest_bytes):
                once = {(d, buf[a:b]) for (a, b), d in zip(spans.T.tolist(), digests, strict=True)}
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in once], pa.binary()), pa.array([c for _, c in once], pa.binary())], names=["digest", "chunk"])

    return run


def exact_groups(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """exact_dedup, and copy: a hash of the row's own text."""
    docs = texts_of(docs).withColumn("copy", F.xxhash64("text"))
    contents = docs.select("text").mapInArrow(tx.task(_contents(digest_bytes)), "digest binary, chunk binary").distinct()
    clash = contents.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest").limit(MOST_CLASHES + 1)
    clashes = frozenset(bytes(r[0]) for r in clash.collect())
    if len(clashes) > MOST_CLASHES:
        if digest_bytes >= LONGEST_DIGEST:
            raise ValueError(f"more than {MOST_CLASHES} digests of {digest_bytes} bytes stand for two contents")
        return exact_groups(docs.drop("copy"), min(LONGEST_DIGEST, 2 * digest_bytes))
    recipes = stored(docs.mapInArrow(tx.task(_recipes(digest_bytes, clashes)), "doc_id long, copy long, recipe binary, text_sha256 string"), "recipes")
    recipes = recipes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = recipes.groupBy("recipe", "salt").agg(F.max("doc_id").alias("m"), F.count("*").alias("n"))
    groups = parts.groupBy("recipe").agg(F.max("m").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    groups = groups.select("recipe", F.explode("salts").alias("salt"), "keep_id", "group_size")
    return recipes.join(groups, ["recipe", "salt"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "copy")


def exact_dedup(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id (largest doc_id of its group of equal texts), group_size, kept, text_sha256."""
    return exact_groups(docs, digest_bytes).drop("copy")


def exact_survivors(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, whole, of each group of equal texts: of the largest doc_id, and of equal rows any."""
    one = exact_groups(docs).where("kept").groupBy("text_sha256").agg(F.first(F.struct("doc_id", "copy")).alias("row"))
    one = one.select(F.coalesce("row.doc_id", F.lit(NULL_ID)).alias("__doc"), F.col("row.copy").alias("__copy"))
    rows = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__copy", F.xxhash64(F.col("text").cast("string")))
    return rows.join(one, ["__doc", "__copy"], "left_semi").dropDuplicates(["__doc", "__copy"]).drop("__doc", "__copy")
