"""Removal of repeated passages of words, prefiltered by a count-min sketch.

First pass: partitions sketch the anchors of their windows of ``width`` words; merged,
the sketch overestimates how often an anchor, and so any window of it, occurs.  Second
pass: the windows whose estimate is two or more, and no others, are grouped by anchor
and 64-bit window hash (128 bits in all), and those that also start in a document of a
smaller doc_id are marked.  Windows that cannot repeat never travel.  Equal runs of
windows of one part of a batch are combined before the shuffle, so a passage that a third of all
documents hold sends a few rows a task, and the windows of an anchor that occurs very often
are dealt by their contexts (see repeats).

Defined results: a null text has no words; rows of null doc_id come before all others;
rows of equal doc_id never mark each other, and repeated rows get equal results; texts
shorter than a window stay whole; a very long text is one row, worked on alone, with memory for
a few numbers a word; an empty table gives an empty result; columns beyond doc_id and
text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .repeats import OFTEN, STEP, Anchors, anchors, dealt, group_heads
from .shared import NULL_ID, partitions_for, stored, text_bytes, texts_of
from .sketch import held, repeated_keys

#: Words of an anchor gram.
GRAM = 8
_OCCURRENCE = "key long, doc long, copy long, first int, n int, windows binary"
_I64 = np.int64


def _word_codes(col):
    """(first row, bytes, offsets, word starts, word ends, word hashes, first word of each text) of runs of rows."""
    for i, j, data, off in tx.slices(col):
        st, en, first = tx.word_bounds(data, off)
        yield i, j, data, st, en, tx.span_hashes(data, st, en), first


def _keys(width: int):
    def run(batch):
        for *_, codes, first in _word_codes(tx.column(batch.column("text"))):
            yield anchors(codes, first, width, GRAM).key

    return run


def _folded(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n codes from each place on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = tx.mix(out * np.uint64(0x9E3779B97F4A7C15) ^ codes[at + j])
    return out


def _occurrences(width: int, sent):
    def run(batches):
        sketch = held(sent)
        for batch in tx.small(batches):
            doc, copy = batch.column("doc").to_numpy(), batch.column("copy").to_numpy()
            got: list[list[np.ndarray]] = [[] for _ in range(6)]
            bodies = []
            for i, j, _, _, _, codes, first in _word_codes(tx.column(batch.column("text"))):
                a = anchors(codes, first, width, GRAM)
                level = sketch.level(a.key)
                if not level.any():
                    continue
                a, level = Anchors(*(x[level > 0] for x in a)), level[level > 0]
                a = dealt(a, level > 1, lambda at: _folded(codes, at, width - STEP + 1))  # noqa: B023
                windows = tx.run_hashes(codes, width)
                at, n = a.first, a.count
                row = np.searchsorted(first, at, "right") - 1
                bodies += np.split(windows[tx.ragged(at, n)], np.cumsum(n)[:-1])
                ident = tx.mix(windows[at] * np.uint64(3) + windows[at + n - 1]) + n.astype(np.uint64)
                for g, v in zip(got, (a.key.view(_I64), doc[i + row], copy[i + row], at - first[row], n, ident), strict=True):
                    g.append(v)
            if not bodies:
                continue
            key, d, c, at, n, ident = (np.concatenate(g) for g in got)
            order = np.lexsort((d, ident, key))
            head = group_heads(key[order], ident[order])
            least = d[order][np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(d), bool)
            later[order] = d[order] > least  # an equal run starts in an earlier document of this task: settled here
            key = np.where(later, tx.mix(key.view(np.uint64) ^ tx.mix(d.view(np.uint64) + at.astype(np.uint64))).view(_I64), key)
            blobs = [b"" if l else b.tobytes() for l, b in zip(later.tolist(), bodies, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(d), pa.array(c), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(blobs, pa.binary())], names=["key", "doc", "copy", "first", "n", "windows"])

    return run


def _marked(batches):
    """Of rows sorted by key and doc: the runs of windows that start in a document of smaller id too."""
    old_key, old_hash, old_doc = None, np.zeros(0, np.uint64), np.zeros(0, _I64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, copy, first, n = (batch.column(c).to_numpy() for c in ("key", "doc", "copy", "first", "n"))
        n = n.astype(_I64)
        blobs = batch.column("windows").to_pylist()
        settled = np.array([not b for b in blobs])
        flat = np.frombuffer(b"".join(blobs), np.uint64)
        body = np.where(settled, 0, n)
        row = np.repeat(np.arange(len(n)), body)
        place = tx.ragged(np.zeros(len(n), _I64), body)
        if old_key == key[0] and len(old_hash):
            keys, hashes, docs = np.concatenate([np.full(len(old_hash), old_key), key[row]]), np.concatenate([old_hash, flat]), np.concatenate([old_doc, doc[row]])
        else:
            old_hash = old_hash[:0]
            keys, hashes, docs = key[row], flat, doc[row]
        order = np.lexsort((docs, hashes, keys))
        head = group_heads(keys[order], hashes[order])
        least = np.empty(len(keys), _I64)
        least[order] = docs[order][np.flatnonzero(head)][np.cumsum(head) - 1] if len(keys) else docs
        dup = (docs > least)[len(old_hash) :]
        # the windows of the last key meet those of the next batch
        mine = np.flatnonzero(head & (keys[order] == key[-1])) if len(keys) else np.zeros(0, _I64)
        old_key, old_hash, old_doc = key[-1], hashes[order][mine], docs[order][mine]
        r, p = row[dup], place[dup]
        start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)])) if len(r) else np.zeros(0, _I64)
        size = np.diff(np.append(start, len(r)))
        r, p = np.concatenate([r[start], np.flatnonzero(settled)]), np.concatenate([p[start], np.zeros(int(settled.sum()), _I64)])
        size = np.concatenate([size, n[settled]])
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(copy[r]), pa.array((first[r] + p).astype(_I64)), pa.array(size)], names=["doc", "copy", "first", "n"])


def covered(n: int, runs: list, width: int) -> np.ndarray:
    """Which of n elements lie in a window of one of the runs (first window, windows)."""
    change = np.zeros(n + 1, np.int32)
    a = np.array([r["first"] for r in runs], _I64)
    b = np.array([r["n"] for r in runs], _I64)
    np.add.at(change, a, 1)
    np.add.at(change, np.minimum(n, a + b + width - 1), -1)
    return np.cumsum(change[:-1]) > 0


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text; doc: the id for joins and orders; copy: tells rows of equal id apart by their text."""
    docs = texts_of(docs)
    return docs.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("copy", F.xxhash64("text"))


def marked_windows(docs: DataFrame, width: int, total: int) -> DataFrame:
    """doc, copy, first, n: runs of windows that also start in a document of smaller id."""
    sent = repeated_keys(docs.select("text"), _keys(width), total / 6 / (width - GRAM + 2) * 2, levels=(2, OFTEN))
    found = docs.select("doc", "copy", "text").mapInArrow(_occurrences(width, sent), _OCCURRENCE)
    found = found.repartition(partitions_for(docs.sparkSession, total * 0.4), "key").sortWithinPartitions("key", "doc")
    runs = stored(found.mapInArrow(_marked, "doc long, copy long, first long, n long"), "runs")
    sent.destroy()
    return runs


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    per_row = runs.groupBy("doc", "copy").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    return docs.join(per_row, ["doc", "copy"], "left").select("doc_id", "text", "runs")


def _kept(width: int):
    def run(batches):
        for batch in tx.small(batches):
            runs = batch.column("runs").to_pylist()
            words, gone, texts = [], [], []
            for i, j, data, st, en, _, first in _word_codes(tx.column(batch.column("text"))):
                keep = np.ones(len(st), bool)
                for k in range(j - i):
                    if runs[i + k]:
                        keep[first[k] : first[k + 1]] = ~covered(int(first[k + 1] - first[k]), runs[i + k], width)
                left = np.concatenate([[0], np.cumsum(keep)])[first]
                size = (en - st + 1)[keep]
                ends = np.cumsum(size)
                buf = data[np.minimum(tx.ragged(st[keep], size), len(data) - 1)]
                buf[ends - 1] = 32
                buf = buf.tobytes()
                edge = np.concatenate([[0], ends])[left].tolist()
                n = np.diff(first)
                words += n.tolist()
                gone += (n - np.diff(left)).tolist()
                texts += [buf[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield batch.column("doc_id"), words, gone, texts

    return run


def _digests(width: int):
    def run(batches):
        for ids, words, gone, texts in _kept(width)(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _texts(width: int):
    def run(batches):
        for ids, words, gone, texts in _kept(width)(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def window_dedup(docs: DataFrame, width: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and text: the kept words joined by one space (or kept_sha256: its digest)."""
    docs = keyed(docs)
    rows = with_runs(docs, marked_windows(docs, width, text_bytes(docs)))
    if digest:
        return rows.mapInArrow(_digests(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return rows.mapInArrow(_texts(width), "doc_id long, n_words long, n_removed long, text string")
