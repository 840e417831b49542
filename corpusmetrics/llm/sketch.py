"""Count-min sketches of 64-bit keys, built by partitions, merged by shards, and held as classes of counts.

A partition counts at most FLUSH keys at a time and sends, for each shard of 2**20
counters, the sorted indices of the counters it raised.  Shards are merged by addition.
What tasks then hold is the class of each counter, one bit for "seen at least twice" or
two bits for three levels: its size is set by the number of keys and bounded by
MOST_BITS, whatever the input.  Estimates are never too low, so no key that repeats is
lost; on inputs beyond that bound more single keys pass, and the exact pass behind it
has more to do.  A sliced sketch may have more counters: it is dealt to broadcasts of
MOST_BITS counters each, and a task looks many keys up in one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import drop, stored

#: log2 of the counters of a row, at least and at most: 2**28 bits are 32 MB.
LEAST_BITS, MOST_BITS = 20, 28
#: The same of all slices of a sliced sketch together, and keys looked up at once in several slices.
SLICED_BITS, LOOKED_UP = 32, 2_000_000
SHARD_BITS = 20
FLUSH = 1_000_000
#: Indices merged by one task at a time.
MERGED = 32_000_000
#: Parts in which the driver fetches a sketch.
FETCHES = 16
_SALT = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)


def index(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    h = keys if row == 0 else tx.mix(keys ^ np.uint64(_SALT[row]))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Sketch:
    """The class of each key's estimated count: how many of the levels it reaches."""

    def __init__(self, rows: list[list[np.ndarray]], bits: int):
        self.rows, self.bits = rows, bits

    def level(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for r, planes in enumerate(self.rows):
            i = index(keys, r, self.bits)
            at, shift = i >> 3, (7 - (i & 7)).astype(np.uint8)
            own = sum(((plane[at] >> shift) & 1) << k for k, plane in enumerate(planes))
            out = own if out is None else np.minimum(out, own)
        return out

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        return self.level(keys) > 0


def bits_for(items: float, room: int = 8) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1.0, items * room)))))


def _emit(keys: list[np.ndarray], rows: int, bits: int, salt: int) -> pa.RecordBatch:
    """Each blob: how many indices each 16th of the shard has, how many counts beyond two; the indices (twice if raised more than once); those counts."""
    flat = np.concatenate(keys)
    out: list[list] = [[], [], [], []]
    for r in range(rows):
        i = np.sort(index(flat, r, bits))
        start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
        uniq, count = i[start], np.diff(np.append(start, len(i)))
        i = np.repeat(uniq, np.minimum(count, 2))
        many = count > 2
        more, times = uniq[many], (count[many] - 2).astype("<u4")
        edges = np.searchsorted(i, np.arange(0, (1 << bits) + 1, 1 << 16))
        extra = np.searchsorted(more, np.arange(0, (1 << bits) + 1, 1 << SHARD_BITS))
        low, high = (i & 0xFFFF).astype("<u2"), (more & ((1 << SHARD_BITS) - 1)).astype("<u4")
        for shard in range(1 << (bits - SHARD_BITS)):
            cut = edges[shard * 16 : shard * 16 + 17]
            if cut[-1] > cut[0]:
                a, b = extra[shard], extra[shard + 1]
                blob = np.append(np.diff(cut), b - a).astype("<u4").tobytes() + low[cut[0] : cut[-1]].tobytes() + high[a:b].tobytes() + times[a:b].tobytes()
                for o, v in zip(out, (r, shard, salt, blob), strict=True):
                    o.append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["row", "shard", "salt", "blob"])


def _counted(pdf: pd.DataFrame) -> np.ndarray:
    counts = np.zeros(1 << SHARD_BITS, np.int64)
    base = np.arange(16, dtype=np.int64) << 16
    for blob in pdf["blob"]:
        sizes = np.frombuffer(blob, "<u4", 17).astype(np.int64)
        n, k = int(sizes[:16].sum()), int(sizes[16])
        i = np.frombuffer(blob, "<u2", n, 68).astype(np.int64) + np.repeat(base, sizes[:16])
        head = np.concatenate([[True], i[1:] != i[:-1]])
        counts[i[head]] += 1
        counts[i[~head]] += 1
        if k:
            counts[np.frombuffer(blob, "<u4", k, 68 + 2 * n)] += np.frombuffer(blob, "<u4", k, 68 + 2 * n + 4 * k)
    return counts


def _partial(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": [key[0]], "shard": [key[1]], "counts": [np.minimum(_counted(pdf), 65535).astype("<u2").tobytes()]})


def _whole(levels: tuple[int, ...]):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = _counted(pdf) if "blob" in pdf else sum(np.frombuffer(c, "<u2").astype(np.int64) for c in pdf["counts"])
        reached = sum((counts >= t).astype(np.uint8) for t in levels)
        planes = b"".join(np.packbits((reached >> k) & 1).tobytes() for k in range(len(levels).bit_length()))
        del counts, reached
        tx.release()
        return pd.DataFrame({"row": [key[0]], "shard": [key[1]], "planes": [planes]})

    return run


def _merged(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], items: float, rows: int, bits: int, levels: tuple[int, ...]) -> DataFrame:
    """row, shard, planes; written."""
    salts = max(1, int(items / (MERGED << (bits - SHARD_BITS))) + 1)

    def run(batches):
        held, n, flushes = [], 0, 0
        for batch in tx.small(batches):
            for keys in keys_of(batch):
                held.append(keys)
                n += len(keys)
                if n >= FLUSH:
                    yield _emit(held, rows, bits, (int(held[0][0]) + flushes) % salts if len(held[0]) else 0)
                    held, n, flushes = [], 0, flushes + 1
        if n:
            yield _emit(held, rows, bits, int(held[0][0]) % salts if len(held[0]) else 0)

    parts = df.mapInArrow(tx.task(run), "row int, shard int, salt int, blob binary")
    if salts > 1:  # a shard's blobs are too many for one task
        parts = parts.groupBy("row", "shard", "salt").applyInPandas(_partial, "row int, shard int, counts binary")
    return stored(parts.groupBy("row", "shard").applyInPandas(_whole(levels), "row int, shard int, planes binary"), "sketch")


def _fetched(merged: DataFrame, rows: int, depth: int, first: int, shards: int) -> list[list[bytearray]]:
    """The planes of ``shards`` shards from ``first`` on; a part of them comes to the driver at a time."""
    width = 1 << (SHARD_BITS - 3)
    planes = [[bytearray(shards * width) for _ in range(depth)] for _ in range(rows)]
    own = merged.where((F.col("shard") >= first) & (F.col("shard") < first + shards))
    for part in range(FETCHES):
        for r in own.where(F.col("shard") % FETCHES == part).select("row", "shard", "planes").collect():
            at = (r[1] - first) * width
            for k in range(depth):
                planes[r[0]][k][at : at + width] = r[2][k * width : (k + 1) * width]
    return planes


def repeated_keys(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], items: float, rows: int = 2, room: int = 8, levels: tuple[int, ...] = (2,)):
    """A broadcast Sketch of all keys that ``keys_of`` finds in the batches of df; ``items``: about how many."""
    bits = bits_for(items, room)
    merged = _merged(df, keys_of, items, rows, bits, levels)
    # at most rows * depth * 2**MOST_BITS bits come to the driver
    planes = _fetched(merged, rows, len(levels).bit_length(), 0, 1 << (bits - SHARD_BITS))
    drop(merged)
    return df.sparkSession.sparkContext.broadcast((planes, bits))


def held(sent) -> Sketch:
    planes, bits = sent.value
    return Sketch([[np.frombuffer(p, np.uint8) for p in row] for row in planes], bits)


class Sliced:
    """A sketch of one row, dealt to broadcasts by its first bits; of several a task holds one at a time."""

    def __init__(self, parts: list, bits: int, slice_bits: int):
        self.parts, self.bits, self.slice_bits = parts, bits, slice_bits
        #: Keys that are worth a look-up.
        self.together = 1 if len(parts) == 1 else LOOKED_UP

    def level(self, keys: np.ndarray) -> np.ndarray:
        if len(self.parts) == 1:
            return held(self.parts[0]).level(keys)
        out = np.zeros(len(keys), np.uint8)
        own = index(keys, 0, self.bits) >> self.slice_bits
        rest = keys << np.uint64(self.bits - self.slice_bits)  # what follows the bits that name the slice
        for k, part in enumerate(self.parts):
            at = np.flatnonzero(own == k)
            if len(at):
                # read anew each time: the value of a broadcast would stay
                planes, bits = part.load_from_path(part._path) if part._path else part.value
                out[at] = Sketch([[np.frombuffer(p, np.uint8) for p in row] for row in planes], bits).level(rest[at])
        return out

    def destroy(self) -> None:
        for part in self.parts:
            part.destroy()


def sliced_keys(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], items: float, levels: tuple[int, ...] = (2,)) -> Sliced:
    """As repeated_keys with one row and about a counter a key, up to 2**SLICED_BITS counters; no more than one slice is at the driver at a time."""
    bits = min(SLICED_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1.0, items)))))
    slice_bits = min(bits, MOST_BITS)
    merged = _merged(df, keys_of, items, 1, bits, levels)
    shards, parts = 1 << (slice_bits - SHARD_BITS), []
    for k in range(1 << (bits - slice_bits)):
        parts.append(df.sparkSession.sparkContext.broadcast((_fetched(merged, 1, len(levels).bit_length(), k * shards, shards), slice_bits)))
    drop(merged)
    return Sliced(parts, bits, slice_bits)
