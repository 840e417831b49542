"""Scores of texts under a smoothed trigram model, as a weighted backoff automaton.

States are the known contexts: all bigrams and words of the training texts, the begin of a
text, and the root.  A state has an arc for every word seen after it, however seldom, and a
failure arc to the state of the context one word shorter; the root's arcs are all words.  With
counts c of the training texts, n(h) uses of h as a context, and m the mass of its order,

    p(w)      = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | h)  = (c(h w) + m p(w | h')) / (n(h) + m),    h' one word shorter
    failure of h: m / (n(h) + m)

(hierarchical Dirichlet smoothing), which sums to one over all known words and one unknown.
A text is read once from left to right: each word follows an arc of the state or fails to
shorter ones until there is one, the log10 weights add up, and the state that is carried on is
the longest known context.  As that depends on two words only, texts are cut into
stretches that are walked side by side, each from the state that the words before it leave.

The model is never in one place.  Documents are kept in blocks of bounded size.  A block
sends the distinct n-grams of its texts, as sorted 64-bit hashes with its own counts, to
shards by ranges of the hash, and gets back just the totals of its own n-grams: the arcs
that it will walk.  No n-gram is left out, and no shard gathers a whole context, so frequent
words load no task more than others; a text longer than a block is cut between words
into several rows that take their contexts along.

Defined results: null texts are empty and consist of the end alone; rows with null doc_id
are held out; repeated rows count and are scored each; ties do not arise; very long texts are
scored whole; an empty training set gives the uniform weights of N = V = 0; an empty
table gives an empty result; columns beyond doc_id and text, whatever their names, are not
read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import partitions_for, stored, text_bytes, texts_of

#: Text of a block, and text whose n-grams make up a shard, in bytes.
BLOCK, SHARD = 8_000_000, 8_000_000
#: Mass given to the shorter context, for contexts of one word, two words (fixed; not fitted to data).
MASS = (300.0, 0.3)
#: Words of a stretch that is walked beside others.
STRETCH = 64
BEGIN, END = np.uint64(0xB5297A4D3F84D5A1), np.uint64(0x68E31DA4C1B2F5E7)
_I64 = np.int64
_JOIN = np.uint64(0x9FB21C651E98DF25)


def cut_text(data: np.ndarray, most: int, before: int):
    """(context words, bytes) of consecutive pieces of about ``most`` bytes, cut between words; the ``before`` words ahead of a piece stand in front of it."""
    at, tail = 0, []
    while True:
        end = len(data)
        if end - at > most:
            spaces = np.flatnonzero(tx.IS_SPACE[data[at + 1 : at + most]])
            if len(spaces):
                end = at + 1 + int(spaces[-1])
            else:  # a word longer than a piece stays whole
                for x in range(at + most, len(data), most):
                    spaces = np.flatnonzero(tx.IS_SPACE[data[x : x + most]])
                    if len(spaces):
                        end = x + int(spaces[0])
                        break
        part = data[at:end]
        yield len(tail), b" ".join([*tail, part.tobytes()])
        if end == len(data):
            return
        st, en, _ = tx.word_bounds(part, np.array([0, len(part)]))
        tail = [*tail, *(part[a:b].tobytes() for a, b in zip(st[-before:].tolist(), en[-before:].tolist(), strict=True))][-before:]
        at = end


def _blocks(most: int):
    """Rows gathered to blocks of about ``most`` bytes of text, compressed.  Read back from a written table, so their names hold."""

    def run(batches):
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
                w.write_table(t.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "body"])

        def packed(doc_id, learn, texts, skip, ends, name) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc_id, learn, texts, pa.array(skip, pa.int32()), pa.array(ends, pa.bool_()), pa.array(name, pa.int64())], names=["doc_id", "learn", "text", "skip", "ends", "row"])

        for batch in tx.small(batches):
            doc_id, learn = batch.column("doc_id"), batch.column("learn")
            texts = tx.column(batch.column("text"))
            for i, j, data, off in tx.slices(texts, min(tx.SLICE, most)):
                n = j - i
                names = [uuid.uuid4().int >> 65 for _ in range(n)]
                if n == 1 and len(data) > most:
                    parts = list(cut_text(data, most, len(MASS)))
                    for k, (skip, part) in enumerate(parts):
                        rows.append(packed(doc_id.slice(i, 1), learn.slice(i, 1), pa.array([part], pa.large_binary()).cast(pa.large_string()), [skip], [k + 1 == len(parts)], names))
                        yield out()
                        rows, size = [], 0
                    continue
                rows.append(packed(doc_id.slice(i, n), learn.slice(i, n), texts.slice(i, n), [0] * n, [True] * n, names))
                size += int(off[-1])
                if size >= most:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return run


class Part:
    """Tokens of a block and their n-grams."""

    def __init__(self, body: bytes):
        t = pa.ipc.open_stream(body).read_all().combine_chunks()
        self.doc_id, self.row = t.column("doc_id"), t.column("row")
        self.learn = t.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        ends = t.column("ends").to_numpy(zero_copy_only=False).astype(bool)
        skip = t.column("skip").to_numpy()
        codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, _I64)]
        for _, _, data, off in tx.slices(tx.column(t.column("text"))):
            st, en, first = tx.word_bounds(data, off)
            codes.append(tx.span_hashes(data, st, en, lower=True))
            counts.append(np.diff(first))
        n = np.concatenate(counts)
        #: tokens of each row: its words, and the end
        self.n = n + ends
        self.start = np.cumsum(self.n) - self.n
        self.word = np.full(int(self.n.sum()), END, np.uint64)
        self.word[tx.ragged(self.start, n)] = np.concatenate(codes)
        self.place = np.arange(len(self.word)) - np.repeat(self.start, self.n)
        #: tokens that are scored: not those that are there as context only
        self.counted = self.place >= np.repeat(skip, self.n)
        self.scored = np.bincount(np.repeat(np.arange(len(n)), self.n)[self.counted], minlength=len(n))
        self.trained = np.repeat(self.learn, self.n) & self.counted

    def grams(self):
        """For n = 1, 2, ..: distinct n-grams that end in a scored token, ascending; counts in training texts; the n-gram of each token (-1: too few words before it)."""
        keys = self.word
        for order in range(len(MASS) + 1):
            if order:
                ahead = np.empty_like(keys)
                ahead[1:] = keys[:-1]
                ahead[self.place == 0] = BEGIN
                keys = tx.mix(ahead * _JOIN ^ self.word)
            have = self.place >= order - 1
            # tokens that are context only need the totals of their own n-grams too: these say which state they leave
            uniq, inv = np.unique(keys[have], return_inverse=True)
            where = np.full(len(keys), -1, np.int32)
            where[have] = inv
            yield uniq, np.bincount(inv[self.trained[have]], minlength=len(uniq)).astype(_I64), where


def _packed(*arrays: np.ndarray, ascending: int = 0) -> bytes:
    """Arrays as bytes, plane by plane; the first ``ascending`` ones as differences."""
    out = [np.array([len(arrays), ascending, *(len(a) for a in arrays)], "<i8").tobytes()]
    for i, a in enumerate(arrays):
        a = a.astype("<u8")
        if i < ascending and len(a):
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, ascending = np.frombuffer(raw, "<i8", 2).tolist()
    out, at = [], 8 * (k + 2)
    for i, n in enumerate(np.frombuffer(raw, "<i8", k, 16).tolist()):
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()
        out.append(np.cumsum(a, dtype=np.uint64) if i < ascending else a)
        at += 8 * n
    return out


def _edges(shards: int) -> np.ndarray:
    """First hash of each shard but the first."""
    return np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)


def _asked(shards: int):
    """The n-grams of the blocks, by shards."""
    edges = _edges(shards)

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                asks = [(uniq, count, np.concatenate([[0], np.searchsorted(uniq, edges), [len(uniq)]])) for uniq, count, _ in Part(body.as_py()).grams()]
                own = [s for s in range(shards) if any(cut[s + 1] > cut[s] for *_, cut in asks)]
                blobs = [_packed(*(u[c[s] : c[s + 1]] for u, _, c in asks), *(n[c[s] : c[s + 1]] for _, n, c in asks), ascending=len(asks)) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([name] * len(own), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "block", "blob"])

    return run


def _totals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to the blocks: how often all others have the n-grams they asked for; and a row with the tokens and words of the shard."""
    parts = [_unpacked(b) for b in pdf["blob"]]
    orders = len(MASS) + 1
    answers: list[list[np.ndarray]] = [[] for _ in parts]
    tokens = words = 0
    for k in range(orders):
        keys = np.concatenate([p[k] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.ones(len(keys), bool)
        head[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(head)
        count = np.concatenate([p[orders + k] for p in parts]).astype(_I64)[order]
        total = np.add.reduceat(count, at) if len(at) else count
        if k == 0:
            tokens, words = int(total.sum()), int((total > 0).sum())
        answer = np.empty(len(keys), _I64)
        answer[order] = total[np.cumsum(head) - 1] - count  # what others add to a block's own count
        size = np.cumsum([0, *(len(p[k]) for p in parts)])
        for a, x, y in zip(answers, size[:-1], size[1:], strict=True):
            a.append(answer[x:y])
    rows = [(key[0], block, _packed(*a), 0, 0) for block, a in zip(pdf["block"], answers, strict=True)]
    rows.append((key[0], -1, None, tokens, words))
    return pd.DataFrame(rows, columns=["shard", "block", "blob", "tokens", "words"])


class Automaton:
    """The part of the model that a block walks, its arcs and failures laid out by the tokens that may take them.

    c[k]: for each token, the total of the (k + 1)-gram that it ends (0: there is no such arc);
    first: which tokens begin a text.
    """

    def __init__(self, c: list[np.ndarray], first: np.ndarray, texts: int, tokens: int, words: int):
        p = (c[0] + 0.1) / (tokens + 0.1 * (words + 1))
        self.arc = [np.log10(p)]
        self.fail: list[np.ndarray] = []
        for order, mass in enumerate(MASS, 1):
            n = np.zeros(len(p))
            n[1:] = c[order - 1][:-1]
            n[first] = texts if order == 1 else 0
            p = (c[order] + mass * p) / (n + mass)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(mass / (n + mass)))
        self.known = c
        # the state that a token leaves: words of the longest known context
        self.left = np.zeros(len(p), np.int8)
        for order in range(1, len(MASS) + 1):
            self.left[c[order - 1] > 0] = order

    def walk(self, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Sums of the weights along stretches of tokens, each walked from its state."""
        by = np.argsort(-size, kind="stable")
        at, size, state, total = start[by], size[by], state[by].copy(), np.zeros(len(by))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))  # stretches that have a token there
            token, now = at[:n] + t, state[:n]
            # an arc of the state, or failure to a shorter one
            for order in range(len(MASS), 0, -1):
                here = np.flatnonzero(now == order)
                x = token[here]
                arc = self.known[order][x] > 0
                total[here] += np.where(arc, self.arc[order][x], self.fail[order - 1][x])
                now[here] = np.where(arc, -1, order - 1)
            here = np.flatnonzero(now == 0)
            total[here] += self.arc[0][token[here]]
            state[:n] = self.left[token]
        out = np.empty(len(by))
        out[by] = total
        return out


def _scored(texts: int, tokens: int, words: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        answers = pdf[pdf["body"].isna()].sort_values("shard")
        parts = [_unpacked(b) for b in answers["blob"]]
        for body in pdf["body"][pdf["body"].notna()]:
            p = Part(body)
            c = []
            for k, (_, own, where) in enumerate(p.grams()):
                total = np.concatenate([np.zeros(0, _I64), *(x[k].astype(_I64) for x in parts)]) + own
                c.append(np.append(total, 0)[where])  # the last stands for -1
            first = p.place == 0
            model = Automaton(c, first, texts, tokens, words)
            # stretches of the scored tokens of each row
            pieces = -(-p.scored // STRETCH)
            row = np.repeat(np.arange(len(pieces)), pieces)
            step = tx.ragged(np.zeros(len(pieces), _I64), pieces) * STRETCH
            start = (p.start + p.n - p.scored)[row] + step
            size = np.minimum(STRETCH, p.scored[row] - step)
            before = np.where(first[start], int(texts > 0), model.left[np.maximum(start - 1, 0)]) if len(start) else np.zeros(0, np.int8)
            sums = np.bincount(row, model.walk(start, size, before.astype(np.int8)), len(pieces))
            own = np.repeat(np.arange(len(pieces)), p.n)[p.counted]
            summed = lambda v: np.bincount(own, v[p.counted], len(pieces))  # noqa: B023, E731
            return pd.DataFrame({"row": p.row.to_numpy(), "doc_id": p.doc_id.to_pandas().astype("Int64"), "held_out": ~p.learn, "n_tokens": p.scored, "n_known": summed((c[0] > 0).astype(float)).astype(_I64), "base_score": summed(model.arc[0]), "score": sums})
        return pd.DataFrame(columns=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def lm_score(docs: DataFrame, learn, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  ``learn``: a condition on doc_id, true for rows learnt from; ``block``: bytes of text worked on at once."""
    docs = texts_of(docs).withColumn("learn", F.coalesce(learn, F.lit(False)))
    total = text_bytes(docs)
    blocks = stored(docs.mapInArrow(_blocks(block), "block long, body binary"), "blocks")
    shards = max(8, int(total / SHARD) + 1)
    asks = blocks.mapInArrow(_asked(shards), "shard int, block long, blob binary")
    answers = stored(asks.groupBy("shard").applyInPandas(_totals, "shard int, block long, blob binary, tokens long, words long"), "answers")
    n, v = answers.where("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    texts = docs.where("learn").count()
    rows = answers.where("block <> -1").select("shard", "block", "blob", F.lit(None).cast("binary").alias("body"))
    rows = rows.unionByName(blocks.select(F.lit(-1).alias("shard"), "block", F.lit(None).cast("binary").alias("blob"), "body"))
    rows = rows.repartition(partitions_for(docs.sparkSession, total, 16e6), "block")
    out = rows.groupBy("block").applyInPandas(_scored(texts, int(n), int(v)), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # the pieces of a text longer than a block are added up
    out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
