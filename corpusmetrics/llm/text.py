"""Vectorised text primitives on the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR
(``[^\\x20\\x09-\\x0D]+``).  Words are represented by 64-bit hashes that are equal in
every process and at every position: words of up to LONG bytes are read as lanes of eight
bytes, each mixed into the hash (no two words of one length up to eight share it);
longer ones have blake2b.  Runs of words are hashed by mixing halves, never by sums, so that
the hash has no algebraic structure which ordinary text could meet.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U8 = np.uint64
#: Text bytes worked on at once; bounds the temporaries to some tens of MB.
SLICE = 500_000
#: Words of more bytes are hashed one by one.
LONG = 64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U8) | U8(1)


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % 2**64
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        have = np.empty(size, U8)
        have[0] = 1
        k, step = 1, base  # step: base**k
        while k < size:
            have[k : 2 * k] = have[:k] * U8(step)
            k, step = 2 * k, step * step % 2**64
        _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser; spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U8(30))
    h = h * U8(0xBF58476D1CE4E5B9)
    h ^= h >> U8(27)
    h *= U8(0x94D049BB133111EB)
    h ^= h >> U8(31)
    return h


def column(arr) -> pa.Array:
    """A string column as one large_string array without nulls (null counts as empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and where each begins (one more entry at the end)."""
    n = len(arr)
    bufs = arr.buffers()
    if n == 0 or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def small(batches, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes: what is made of a part is sent on before the next one is worked on."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for i in range(0, max(1, batch.num_rows), step):
            yield batch.slice(i, step)
            release()


def release() -> None:
    """Gives memory that allocators hold but nothing uses back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def task(run):
    """``run``, a function from batches to batches; when it has ended and its frame is gone, so is the memory it had."""

    def whole(batches):
        yield from run(batches)
        release()

    return whole


def slices(arr: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``most`` bytes; a longer text stands alone."""
    data, off = raw(arr)
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each text's first word (one more entry at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    st = np.flatnonzero(first)
    en = np.flatnonzero(last) + 1
    return st, en, np.searchsorted(st, off)


_ODD, _TURN = U8(0x9FB21C651E98DF25), U8(0xA24BAED4963EE407)
_KEEP = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], dtype=U8)


def lanes(data: np.ndarray) -> np.ndarray:
    """Entry i: bytes i .. i + 7 as a little-endian number, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def heads(at: np.ndarray, st: np.ndarray, en: np.ndarray, n: int) -> np.ndarray:
    """The first n (at most 8) bytes of each span of ``lanes`` as a number; shorter spans have all theirs."""
    return at[st] & _KEEP[np.minimum(en - st, n)]


def span_hashes(data: np.ndarray, st: np.ndarray, en: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    if lower:
        data = LOWER[data]
    size = en - st
    at = lanes(data)
    out = mix(heads(at, st, en, 8) ^ (size.astype(U8) * _ODD))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    k = 8
    while len(more):
        part = at[st[more] + k] & _KEEP[np.minimum(size[more] - k, 8)]
        out[more] = mix(out[more] * _TURN ^ part)
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[st[i] : en[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def run_hashes(codes: np.ndarray, width: int, salt: int = 0, chunk: int = 1 << 17) -> np.ndarray:
    """Entry i: hash of codes[i : i + width] as a sequence; len(codes) - width + 1 entries (none if shorter)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U8)
    out = np.empty(n, U8)
    for i in range(0, n, chunk):
        m = min(chunk, n - i)
        run, size, have, done = codes[i : i + m + width - 1] ^ U8(salt), 1, None, 0
        while True:
            if width & size:  # runs of this power of two are part of the width
                own = run[done : done + m]
                have = own if have is None else mix(have * _TURN ^ own)
                done += size
            if 2 * size > width:
                break
            run = mix(run[:-size] * _ODD ^ run[size:])
            size *= 2
        out[i : i + m] = mix(have + U8(width))
    return out


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODES[data]


_SEQ = 0xD6E8FEB86659FD93
_SEQ_INV = _inverse(_SEQ)


class Rolling:
    """Hashes of all runs of a fixed number of elements of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray, chunk: int = 1 << 18):
        self.codes, self.chunk = codes, chunk

    def windows(self, width: int, salt: int = 0) -> np.ndarray:
        """Entry i: hash of codes[i : i + width]; len(codes) - width + 1 entries (none if shorter)."""
        n = len(self.codes) - width + 1
        if n <= 0:
            return np.zeros(0, U8)
        out = np.empty(n, U8)
        for i in range(0, n, self.chunk):
            j = min(n, i + self.chunk)
            part = self.codes[i : j + width - 1]
            acc = np.empty(len(part) + 1, U8)
            acc[0] = 0
            np.cumsum(part * powers(_SEQ, len(part)), out=acc[1:])
            m = j - i
            out[i:j] = mix((acc[width : width + m] - acc[:m]) * powers(_SEQ_INV, m) + U8(salt * 0x632BE5AB + width))
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Entry i: the least of x[i : i + width]."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of starts[0], .., starts[0] + lens[0] - 1, starts[1], .."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
