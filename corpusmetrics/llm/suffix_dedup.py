"""Removal of repeated byte strings by suffix sorting in blocks, with difference-cover ranks.

Suffixes whose first ``depth`` bytes may stand twice are found first: a count-min sketch
of anchors (see repeats) drops the others, which can have no equal.  The rest is sorted
one block of suffix buckets at a time; a bucket holds the suffixes of one anchor gram at
one distance from it.  The text of a block is laid out with the anchors at multiples of
the cover's period, and the suffixes at cover positions are ranked once, by prefix
doubling.  A bucket is then sorted by the few bytes up to the next cover position and
the rank there, so long ties cost one comparison and a block's memory is bounded by its
text; buckets of anchors that occur very often are dealt by their contexts (see repeats).
Neighbours in the order that agree on ``depth`` bytes are one string; all but its
first occurrence are marked, and marked strings cover the bytes to remove.

Defined results: a null text is empty; rows of null doc_id come before all others; rows
of equal doc_id count as one document, so a byte string at one start in both is not
earlier in either, and repeated rows get equal results; texts shorter than ``depth``
bytes hold no match; of ties (equal strings of one document) the leftmost is the first; a very
long text is one row, worked on alone, with memory for some numbers a byte; an empty
table gives an empty result; columns beyond doc_id and text, whatever their names, are
not read (``suffix_deduped`` carries them along, and gives a null text back as empty).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .repeats import OFTEN, STEP, Anchors, anchors, dealt, group_heads
from .shared import NULL_ID, partitions_for, stored, text_bytes
from .sketch import held, repeated_keys
from .window_dedup import covered, keyed, with_runs

GRAM = 32
#: Period of the difference cover, and the most bytes from any position to the next one of the cover.
PERIOD, REACH = 32, 8
#: Text sorted as one block, and text whose anchors are found at once: every byte of it has several numbers of eight bytes.
BLOCK, CODED = 400_000, 200_000
_OCCURRENCE = "key long, doc long, copy long, at int, back int, n int, body binary"
_I64 = np.int64


def difference_cover(period: int, reach: int) -> list[int]:
    """Residues whose differences are all residues modulo ``period``, with gaps of at most ``reach``."""
    cover = list(range(0, period, reach))
    while len(have := {(a - b) % period for a in cover for b in cover}) < period:
        cover.append(max((x for x in range(period) if x not in cover), key=lambda x: (len(have | {(x - a) % period for a in cover} | {(a - x) % period for a in cover}), -x)))
    return sorted(cover)


COVER = difference_cover(PERIOD, REACH)
_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[COVER] = True
_NEXT = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Rank of each row of columns (most significant last), equal rows sharing one, from 1."""
    order = np.lexsort(keys)
    out = np.empty(len(keys[0]), _I64)
    out[order] = np.cumsum(group_heads(*(k[order] for k in keys)))
    return out


def equal_strings(bodies: list[bytes], back: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every string of ``depth`` bytes of the bodies (each anchored at byte ``back``): its body, start, and a class.

    Strings of one group and one distance from the anchor share a class if and only if they are equal.
    """
    size = np.fromiter(map(len, bodies), _I64, len(bodies))
    # lay out: the anchor of each body at a multiple of PERIOD, and at least one zero byte between bodies
    room = -(-(size + PERIOD + 1) // PERIOD) * PERIOD
    base = np.cumsum(room) - room + (-back) % PERIOD
    end = base + size
    text = np.zeros(int(room.sum()) + PERIOD + 8, np.uint8)
    text[tx.ragged(base, size)] = np.frombuffer(b"".join(bodies), np.uint8)
    # ranks of the cover positions, by prefix doubling
    inside = tx.ragged(base, size)
    owner = np.repeat(np.arange(len(bodies)), size)
    pick = _IN_COVER[inside % PERIOD]
    sample, own = inside[pick], owner[pick]
    eight = np.lib.stride_tricks.sliding_window_view(text, 8)
    word = lambda p: np.ascontiguousarray(eight[p]).view(">u8").ravel().astype(np.uint64)
    left = np.clip(end[own] - sample, 0, PERIOD)
    keys = []
    for k in range(PERIOD // 8):
        have = np.clip(left - 8 * k, 0, 8)
        w = word(np.minimum(sample + 8 * k, len(text) - 8))
        keys.append(np.where(have == 0, np.uint64(0), w >> ((8 - np.maximum(have, 1)) * 8).astype(np.uint64) << ((8 - np.maximum(have, 1)) * 8).astype(np.uint64)))
    rank = _dense(left, *keys[::-1])
    number = np.full(len(text), -1, np.int32)
    number[sample] = np.arange(len(sample), dtype=np.int32)
    reach = PERIOD
    while reach < depth:
        beyond = sample + reach
        ok = beyond < end[own]
        rank = _dense(np.where(ok, rank[number[np.where(ok, beyond, sample)]], 0), rank)
        reach *= 2
    # the suffixes to sort
    n = size - depth + 1
    own = np.repeat(np.arange(len(bodies)), n)
    start = tx.ragged(np.zeros(len(bodies), _I64), n)
    at = base[own] + start
    gap = _NEXT[at % PERIOD]
    few = word(at) >> ((8 - np.maximum(gap, 1)) * 8).astype(np.uint64)
    few = np.where(gap == 0, np.uint64(0), few)
    distance = start - back[own]
    order = np.lexsort((rank[number[at + gap]], few, distance, group[own]))
    # neighbours that agree on depth bytes
    head = group_heads(group[own][order], distance[order], few[order])
    same = np.flatnonzero(~head)
    long = np.lib.stride_tricks.sliding_window_view(text, depth)
    for i in range(0, len(same), 1 << 15):
        part = same[i : i + (1 << 15)]
        a, b = at[order[part - 1]], at[order[part]]
        head[part] = (long[a] != long[b]).any(axis=1)
    kind = np.empty(len(order), _I64)
    kind[order] = np.cumsum(head) - 1
    return own, start, kind


def _codes(col):
    for i, j, data, off in tx.slices(col, CODED):
        yield i, j, data, off, tx.byte_codes(data)


def _keys(depth: int):
    def run(batch):
        for _, _, _, off, codes in _codes(tx.column(batch.column("text"))):
            yield anchors(codes, off, depth, GRAM).key

    return run


def _occurrences(depth: int, sent):
    def run(batches):
        sketch = held(sent)
        for batch in tx.small(batches):
            doc, copy = batch.column("doc").to_numpy(), batch.column("copy").to_numpy()
            got: list[list[np.ndarray]] = [[] for _ in range(6)]
            bodies = []
            for i, j, data, off, codes in _codes(tx.column(batch.column("text"))):
                a = anchors(codes, off, depth, GRAM)
                level = sketch.level(a.key)
                if not level.any():
                    continue
                a, level = Anchors(*(x[level > 0] for x in a)), level[level > 0]
                a = dealt(a, level > 1, lambda at: tx.span_hashes(data, at, at + (depth - STEP + 1)))  # noqa: B023
                at, n = a.first, a.count
                row = np.searchsorted(off, at, "right") - 1
                buf = data.tobytes()
                bodies += [buf[x:y] for x, y in zip(at.tolist(), (at + n - 1 + depth).tolist(), strict=True)]
                for g, v in zip(got, (a.key.view(_I64), doc[i + row], copy[i + row], at - off[row], a.at - at, n), strict=True):
                    g.append(v)
            if not bodies:
                continue
            key, d, c, at, back, n = (np.concatenate(g) for g in got)
            ident = pa.array(bodies, pa.binary()).dictionary_encode().indices.to_numpy()
            order = np.lexsort((at, d, ident, back, key))
            head = group_heads(key[order], back[order], ident[order])
            lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(d), bool)
            later[order] = (d[order] != d[lead]) | (at[order] != at[lead])  # an equal body starts earlier in this part: settled here
            key = np.where(later, tx.mix(key.view(np.uint64) ^ tx.mix(d.view(np.uint64) + at.astype(np.uint64))).view(_I64), key)
            cols = [pa.array(key), pa.array(d), pa.array(c), *(pa.array(x.astype(np.int32)) for x in (at, back, n)), pa.array([None if l else b for l, b in zip(later.tolist(), bodies, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc", "copy", "at", "back", "n", "body"])

    return run


def _block(key, doc, at, back, n, bodies, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key, doc, at.  For each row whether it is the first of its body, and the marked strings of those that are: (row, place); also those rows."""
    code = pa.array(bodies, pa.binary()).dictionary_encode().indices.to_numpy()
    order = np.lexsort((at, doc, code, back, key))
    head = group_heads(key[order], back[order], code[order])
    lead = order[np.flatnonzero(head)]
    lead_of = np.empty(len(key), _I64)
    lead_of[order] = lead[np.cumsum(head) - 1]
    first = (doc == doc[lead_of]) & (at == at[lead_of])
    # keys with one body need no sorting
    lead = np.sort(lead)
    heads = group_heads(key[lead])
    number = np.cumsum(heads) - 1 if len(lead) else np.zeros(0, _I64)
    many = lead[np.bincount(number)[number] > 1] if len(lead) else lead
    rows, places = [], []
    lens = np.fromiter((len(bodies[i]) for i in many), _I64, len(many))
    total = np.cumsum(lens)
    i = 0
    while i < len(many):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK, "right"))
        j = max(j, i + 1)
        while j < len(many) and key[many[j]] == key[many[j - 1]]:
            j += 1
        part = many[i:j]
        group = np.cumsum(group_heads(key[part]))
        own, start, kind = equal_strings([bodies[x] for x in part], back[part].astype(_I64), group, depth)
        # ``part`` ascends by doc and at within a key: the first string of a class is its earliest
        d, p = doc[part][own], at[part][own] + start
        by = np.lexsort((p, d, kind))
        head = group_heads(kind[by])
        lead = by[np.flatnonzero(head)][np.cumsum(head) - 1]
        late = by[(d[by] != d[lead]) | (p[by] != p[lead])]
        rows.append(part[own[late]])
        places.append(start[late])
        i = j
    none = np.zeros(0, _I64)
    return first, lead_of, np.concatenate([none, *rows]), np.concatenate([none, *places])


def _marked(depth: int):
    def run(batches):
        carry = None  # the bodies of the last key so far: (key, doc, at, back, n, bodies)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, copy, at, back, n = (batch.column(c).to_numpy() for c in ("key", "doc", "copy", "at", "back", "n"))
            at, back, n = at.astype(_I64), back.astype(_I64), n.astype(_I64)
            body = batch.column("body")
            settled = np.flatnonzero(body.is_null().to_numpy(zero_copy_only=False))
            live = np.flatnonzero(~body.is_null().to_numpy(zero_copy_only=False))
            bodies = body.drop_null().to_pylist()
            out = [(doc[settled], copy[settled], at[settled], n[settled])]
            k, d, a, b, m = key[live], doc[live], at[live], back[live], n[live]
            old = 0
            if carry is not None and len(k) and carry[0][0] == k[0]:
                old = len(carry[0])
                k, d, a, b, m = (np.concatenate([x, y]) for x, y in zip(carry[:5], (k, d, a, b, m), strict=True))
                bodies = carry[5] + bodies
            if len(k):
                first, lead_of, row, place = _block(k, d, a, b, m, bodies, depth)
                c = np.concatenate([np.zeros(old, _I64), copy[live]])
                late = np.flatnonzero(~first)
                late = late[late >= old]
                out.append((d[late], c[late], a[late], m[late]))
                # every row that is first of its body has the marks of the row that led it
                by = np.lexsort((place, row))
                row, place = row[by], place[by]
                start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])) if len(row) else np.zeros(0, _I64)
                size = np.diff(np.append(start, len(row)))
                row, place = row[start], place[start]
                twins = np.flatnonzero(first)
                twins = twins[twins >= old]
                lo, hi = np.searchsorted(row, lead_of[twins], "left"), np.searchsorted(row, lead_of[twins], "right")
                pick = tx.ragged(lo, hi - lo)
                who = np.repeat(twins, hi - lo)
                out.append((d[who], c[who], a[who] + place[pick], size[pick]))
                last = np.unique(lead_of[k == k[-1]])
                carry = (k[last], d[last], a[last], b[last], m[last], [bodies[x] for x in last])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc", "copy", "first", "n"])

    return run


def _kept(depth: int):
    def run(batches):
        for batch in tx.small(batches):
            runs = batch.column("runs").to_pylist()
            out = []
            for i, j, data, off in tx.slices(tx.column(batch.column("text"))):
                buf = data.tobytes()
                for k in range(j - i):
                    a, b = int(off[k]), int(off[k + 1])
                    if not runs[i + k]:
                        out.append((b - a, 0, 0, buf[a:b]))
                        continue
                    gone = covered(b - a, runs[i + k], depth)
                    out.append((b - a, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]), data[a:b][~gone].tobytes()))
            yield batch, out

    return run


def _digests(depth: int):
    def run(batches):
        for batch, out in _kept(depth)(batches):
            cols = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)] + [pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _replaced(depth: int):
    def run(batches):
        for batch, out in _kept(depth)(batches):
            text = pa.array([o[3].decode(errors="ignore") for o in out], batch.column("text").type)
            names = [n for n in batch.schema.names if n != "runs"]
            yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names=names)

    return run


def marked_strings(docs: DataFrame, depth: int, total: int) -> DataFrame:
    """doc, copy, first, n: runs of ``depth``-byte strings that also start earlier."""
    sent = repeated_keys(docs.select("text"), _keys(depth), total / (depth - GRAM + 2) * 2, room=4, levels=(2, OFTEN))
    found = docs.select("doc", "copy", "text").mapInArrow(tx.task(_occurrences(depth, sent)), _OCCURRENCE)
    found = found.repartition(partitions_for(docs.sparkSession, total), "key").sortWithinPartitions("key", "doc", "at")
    runs = stored(found.mapInArrow(tx.task(_marked(depth)), "doc long, copy long, first long, n long"), "runs")
    sent.destroy()
    return runs


def suffix_dedup(docs: DataFrame, depth: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes)."""
    docs = keyed(docs)
    rows = with_runs(docs, marked_strings(docs, depth, text_bytes(docs)))
    return rows.mapInArrow(tx.task(_digests(depth)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_deduped(docs: DataFrame, depth: int = 100) -> DataFrame:
    """``docs`` whole, with what remains of each text; a character that is cut in two goes altogether.  n_chars follows."""
    own = keyed(docs)
    runs = marked_strings(own, depth, text_bytes(own)).groupBy("doc", "copy").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    runs = runs.select(F.col("doc").alias("__doc"), F.col("copy").alias("__copy"), "runs")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__doc"),
        F.xxhash64(F.col("text").cast("string")).alias("__copy"),
    )
    rows = rows.join(runs, ["__doc", "__copy"], "left").drop("__doc", "__copy")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "runs")
    done = rows.mapInArrow(tx.task(_replaced(depth)), kinds)
    place = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {"text": F.col("text")}
    if "n_chars" in place:
        place["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*(place[c].alias(c) for c in docs.columns))
