"""Merge-type (BPE) SentencePiece encoding and decoding without the library's merge queue.

Encoding backtracks over longest vocabulary matches (Aho-Corasick).  A piece may follow
another if re-merging cannot join across their border: undoing the later of the two
merges at the border, again and again, never shows a pair that would have merged first.
Positions from which no valid rest exists are set in a bitfield.  A text is first
cut wherever no piece of the vocabulary could span, and every distinct cut is encoded
once, whatever its length.  Merges of equal rank (runs of spaces) happen from left to right.

Defined results: a null text is an empty one and has only the begin and end ids; rows
with null doc_id and repeated rows are encoded like any other; very long texts are
worked on alone, in time and memory that grow with their length; an empty table gives
an empty result; columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import text as tx
from .encoder import SpanEncoder
from .shared import texts_of

MARK = "▁"  # stands for a space in pieces


class PieceCodec:
    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in normal}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        # the rank of a piece is the time of the merge that makes it: single characters come first
        self.rank = {p: (-1.0 if len(p) == 1 else 1e12 - sp.get_score(i)) for p, i in self.id.items()}
        self.half: dict[str, tuple[str, str]] = {}
        self.words = ahocorasick.Automaton()
        for p in sorted(self.id, key=lambda p: self.rank[p]):
            if len(p) == 1:
                self.words.add_word(p, p)
            else:
                done, last = self.merge(p)
                if done == [p]:
                    self.half[p] = last
                    self.words.add_word(p, p)
        self.words.make_automaton()
        self.joins: dict[tuple[str, str], bool] = {}
        self.raw = [b""] * n
        for p, i in self.id.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        if self.unk >= 0:
            self.raw[self.unk] = " ⁇ ".encode()
        self.raw_len = np.array([len(b) for b in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_len) - self.raw_len
        self.raw_pool = np.frombuffer(b"".join(self.raw), np.uint8)
        self.spaced = np.array([p.startswith(MARK) and p in self.id for p in self.piece])
        # byte pairs that stand side by side within some piece or character
        self.inside = np.zeros((256, 256), bool)
        self.inside[:, 0x80:0xC0] = True
        for p in self.id:
            b = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.spans = SpanEncoder(lambda spans: [self.encode_span(s.decode().replace(" ", MARK)) for s in spans])

    def merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging: the best pair first, the leftmost of equals.  Also the last pair merged."""
        part: list[str | None] = list(s)
        after = [*range(1, len(s)), -1]
        before = [*range(-1, len(s) - 1)]
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (r := self.rank.get(both := part[i] + part[after[i]])) is not None:
                heapq.heappush(queue, (r, i, both))

        for i in range(len(s) - 1):
            offer(i)
        last = None
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if part[i] is None or j < 0 or part[i] + part[j] != both:
                continue
            last = (part[i], part[j])
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None], last

    def may_follow(self, a: str, b: str) -> bool:
        key = (a, b)
        if (known := self.joins.get(key)) is not None:
            return known
        rank, half, bound, ok = self.rank, self.half, float("inf"), True
        closed = False  # whether a merge at the bound itself would still come first
        while True:
            if (r := rank.get(a + b)) is not None and (r < bound or closed and r == bound):
                ok = False
                break
            ra, rb = rank.get(a, -1.0), rank.get(b, -1.0)
            if ra > rb:  # a was made last: what stood to the left of the border before
                bound, closed, a = ra, False, half[a][1]
            elif rb < 0:
                break
            else:  # b was made last; at equal rank the pair at the border lies further left
                bound, closed, b = rb, True, half[b][0]
        if len(self.joins) > 500_000:
            self.joins.clear()
        self.joins[key] = ok
        return ok

    def encode_span(self, s: str) -> list[int]:
        return [i for p in self.backtrack(s) for i in self.ids_of(p)]

    def ids_of(self, p: str) -> list[int]:
        if (i := self.id.get(p)) is not None:
            return [i]
        return [self.byte[b] for b in p.encode()] if self.byte else [self.unk]

    def backtrack(self, s: str) -> list[str]:
        n = len(s)
        starts: list[list[str]] = [[] for _ in range(n)]  # matches by start; ends ascend, so lengths do
        for end, p in self.words.iter(s):
            starts[end - len(p) + 1].append(p)
        for i in range(n):
            if not starts[i] or len(starts[i][0]) > 1:
                starts[i].insert(0, s[i])  # a character without piece stands alone
        failed = bytearray((n >> 3) + 1)  # one bit a position
        out: list[str] = []
        tried: list[int] = []  # index of the chosen match at each chosen start
        pos, k = 0, len(starts[0]) - 1 if n else -1
        while pos < n:
            while k >= 0:
                p = starts[pos][k]
                end = pos + len(p)
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.may_follow(out[-1], p)):
                    break
                k -= 1
            if k >= 0:
                out.append(p)
                tried.append(k)
                pos += len(p)
                k = len(starts[pos]) - 1 if pos < n else -1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                pos -= len(out.pop())
                k = tried.pop() - 1
        return out

    def encode_many(self, texts: pa.Array):
        """For each run of rows: (first row, end row, ids without begin and end, where each row's ids begin)."""
        # the library puts one space before a text that isn't empty
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        texts = pc.replace_substring(texts, MARK, " ")
        for i, j, data, off in tx.slices(texts):
            cut = np.ones(len(data), bool)
            cut[1:] = ~self.inside[data[:-1], data[1:]]
            cut[off[:-1][off[:-1] < len(data)]] = True
            st = np.flatnonzero(cut)
            en = np.append(st[1:], len(data))
            ids, sizes = self.spans(data, st, en)
            yield i, j, ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(st, off)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text of ``ids`` (begin and end ids have none), without the one space in front."""
        lens = self.raw_len[ids]
        out = self.raw_pool[tx.ragged(self.raw_start[ids], lens)].tobytes()
        spoken = ids[lens > 0][:1]
        if len(spoken) and self.spaced[spoken[0]]:
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            out = replaced(out)
        return out


def replaced(b: bytes) -> bytes:
    """Each byte that is part of no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(b):
        for n in (1, 2, 3, 4):
            try:
                b[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            out.append(b[i : i + n])
            i += n
            break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    if model not in _CODECS:
        _CODECS[model] = PieceCodec(model)
    return _CODECS[model]


def _coded(model: str):
    def run(batches):
        c = codec(model)
        for batch in tx.small(batches):
            counts, ids_sha, text_sha = [], [], []
            for i, j, ids, ends in c.encode_many(tx.column(batch.column("text"))):
                for k in range(j - i):
                    doc = np.concatenate([[c.bos], ids[ends[k] : ends[k + 1]], [c.eos]]).astype("<u4")
                    counts.append(len(doc))
                    ids_sha.append(hashlib.sha256(doc.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(doc)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(model: str):
    def run(batches):
        c = codec(model)
        for batch in tx.small(batches):
            rows = [np.concatenate([[c.bos], ids[ends[k] : ends[k + 1]], [c.eos]]).astype(np.int32) for i, j, ids, ends in c.encode_many(tx.column(batch.column("text"))) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids with begin and end ids."""
    return texts_of(docs).mapInArrow(_ids(model), "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of ``coded`` (doc_id, ids); null ids give an empty text."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from them."""
    return texts_of(docs).mapInArrow(_coded(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
