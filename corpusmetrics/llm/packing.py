"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents become token ids plus a separator; those longer than a sequence are cut.
The driver sees only how many pieces have each length (at most ``size`` numbers) and
runs best-fit decreasing on these counts: all bins with the same free room are one
entry, so the plan is a list of runs "pieces a..b of length l, m to a sequence, from
sequence s at offset o".  Pieces then take their slots by rank within their length.
Ranks come from counts by (length, salt), with more salts the more pieces there are, so
a length that a third of all pieces share is ranked by many tasks.

Defined results: null texts and texts without tokens are one piece of length 1 (the
separator); rows with null doc_id and repeated rows are packed like any other; very long
texts are cut into as many pieces as they need; pieces of equal length (ties) take
their slots by salt, doc_id, piece and checksum; an empty table gives an empty result;
columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import heapq
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .encoder import SpanEncoder
from .shared import stored, texts_of

#: A span may be cut between a letter of A-Z, a-z and one of these, on either side: no pre-token holds both.
APART = b".,;:!?*&%$#()\"/-"
#: Salts of a length: at least LEAST_SALTS, and one for so many pieces.
LEAST_SALTS, PIECES_A_SALT = 64, 500_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_APART = np.zeros(256, bool)
_APART[list(APART)] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    st, en, _ = tx.word_bounds(data, off)
    cut = _LETTER[data[:-1]] & _APART[data[1:]] | _APART[data[:-1]] & _LETTER[data[1:]]
    inner = np.flatnonzero(cut) + 1
    if len(inner):
        w = np.searchsorted(st, inner, "right") - 1
        inner = inner[(w >= 0) & (inner > st[np.maximum(w, 0)]) & (inner < en[np.maximum(w, 0)])] if len(st) else inner[:0]
    return np.sort(np.concatenate([st, inner])), np.sort(np.concatenate([en, inner]))


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, pieces to a sequence, first sequence, offset), longest lengths first."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, sequences)
    runs, sequences = [], 0
    open_rooms: list[int] = []  # sorted free rooms in use
    def add(room: int, first: int, n: int) -> None:
        if room not in rooms:
            bisect.insort(open_rooms, room)
            rooms[room] = []
        heapq.heappush(rooms[room], (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(open_rooms, length)
            if k == len(open_rooms):
                fit = size // length
                n = max(1, left // fit)
                add(size, sequences, n)
                sequences += n
                continue
            room = open_rooms[k]
            first, n = heapq.heappop(rooms[room])
            each = room // length
            use = min(n, left // each)
            if not use:  # the last sequence of this length gets what is left
                each, use = left, 1
            if n > use:
                heapq.heappush(rooms[room], (first + use, n - use))
            if not rooms[room]:
                del rooms[room]
                open_rooms.pop(k)
            runs.append((length, rank, use * each, each, first, size - room))
            rank += use * each
            left -= use * each
            if room - each * length:
                add(room - each * length, first, use)
    return runs


_ENCODERS: dict[str, SpanEncoder] = {}


def _encoder(path: str) -> SpanEncoder:
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _ENCODERS[path] = SpanEncoder(lambda spans: [e.ids for e in tok.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)])
    return _ENCODERS[path]


def _pieces(path: str, separator: int, size: int):
    def run(batches):
        for batch in tx.small(batches):
            out: list[list] = [[], [], [], [], []]
            col = tx.column(batch.column("text"))
            ids_of = batch.column("doc_id").to_pylist()
            for i, j, data, off in tx.slices(col):
                st, en = word_spans(data, off)
                ids, sizes = _encoder(path)(data, st, en)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(st, off)]
                for k in range(j - i):
                    doc = np.append(ids[ends[k] : ends[k + 1]], np.uint32(separator)).astype("<u4")
                    for p, a in enumerate(range(0, len(doc), size)):
                        part = doc[a : a + size]
                        for o, v in zip(out, (ids_of[i + k], p, a, len(part), zlib.crc32(part.tobytes())), strict=True):
                            o.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        _encoder(path).rest()

    return run


def token_pieces(docs: DataFrame, tokenizer: str, separator: int = 1, size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    return texts_of(docs).mapInArrow(tx.task(_pieces(tokenizer, separator, size)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """``pieces`` (any columns with an integral length of 1..size) with sequence_id and offset."""
    spark = pieces.sparkSession
    salts = max(LEAST_SALTS, pieces.count() // PIECES_A_SALT)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece") if c in pieces.columns]), F.lit(salts)))
    counts = stored(salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")), "lengths")  # at most size * salts rows
    total = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("__n")).collect()}
    runs: dict[int, list] = {}
    for length, *run in best_fit_plan(total, size):
        runs.setdefault(length, []).append(tuple(run))
    plan = spark.createDataFrame(sorted(runs.items()), "length long, __runs array<struct<rank: long, n: long, each: long, first: long, at: long>>")
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select(F.col("length").alias("__l"), F.col("__salt").alias("__s"), F.coalesce(before, F.lit(0)).alias("__before"))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = salted.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("__l")) & (F.col("__salt") == F.col("__s"))).withColumn("__r", F.col("__r") + F.col("__before"))
    # lengths are at most ``size``, and the plan has few runs for each
    slot = F.expr("element_at(filter(__runs, r -> __r >= r.rank and __r < r.rank + r.n), 1)")
    placed = ranked.join(F.broadcast(plan), "length").withColumn("__slot", slot)
    return placed.select(
        *pieces.columns,
        F.expr("__slot.first + (__r - __slot.rank) div __slot.each").alias("sequence_id"),
        F.expr("__slot.at + ((__r - __slot.rank) % __slot.each) * length").alias("offset"),
    )


def best_fit_packing(docs: DataFrame, tokenizer: str, separator: int = 1, size: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(stored(token_pieces(docs, tokenizer, separator, size), "pieces"), size)
