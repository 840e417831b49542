"""Ids of many short spans of bytes: each distinct span is encoded once and looked up afterwards.

Spans are found by their hashes and recognised by their bytes: one whose bytes differ from those
known under its hash is encoded on its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import text as tx

#: The memory of a task for known spans; when it is full, it starts anew (a matter of speed only).
MOST_SPANS, MOST_IDS = 1_000_000, 8_000_000
#: With more known spans than this, a worker forgets them when its task ends.
KEPT_SPANS = 600_000
#: Spans given to the encoder at once: what it makes of a span is far larger than its ids.
ENCODED = 4096


def differing(a: np.ndarray, a_st: np.ndarray, b: np.ndarray, b_st: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the pairs of spans (of equal size) of ``a`` and ``b`` differ."""
    unlike = a[tx.ragged(a_st, size)] != b[tx.ragged(b_st, size)]
    if not unlike.any():
        return np.zeros(len(size), bool)
    count = np.concatenate([[0], np.cumsum(unlike)])
    ends = np.cumsum(size)
    return count[ends] > count[ends - size]


class SpanEncoder:
    def __init__(self, encode: Callable[[list[bytes]], list], hashes: Callable = tx.span_hashes):
        self.encode, self.hashes = encode, hashes
        self.reset()

    def reset(self):
        self.hash = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        # the bytes of the known spans
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def rest(self):
        """At the end of a task."""
        if len(self.hash) > KEPT_SPANS:
            self.reset()

    def _flat(self, data: np.ndarray, st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(st), ENCODED):
            ids = self.encode([data[a:b].tobytes() for a, b in zip(st[i : i + ENCODED].tolist(), en[i : i + ENCODED].tolist(), strict=True)])
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((x for y in ids for x in y), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, data: np.ndarray, st: np.ndarray, en: np.ndarray, keys: np.ndarray) -> None:
        flat, sizes = self._flat(data, st, en)
        length = en - st
        order = np.argsort(np.concatenate([self.hash, keys]), kind="stable")
        join = lambda old, new: np.concatenate([old, new])[order]
        self.start = join(self.start, len(self.pool) + np.cumsum(sizes) - sizes)
        self.at = join(self.at, len(self.bytes) + np.cumsum(length) - length)
        self.hash, self.size, self.length = join(self.hash, keys), join(self.size, sizes), join(self.length, length)
        self.pool = np.concatenate([self.pool, flat])
        self.bytes = np.concatenate([self.bytes, data[tx.ragged(st, length)]])

    def __call__(self, data: np.ndarray, st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each span has."""
        if not len(st):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.hash) > MOST_SPANS or len(self.pool) > MOST_IDS or len(self.bytes) > MOST_IDS:
            self.reset()
        uniq, first, inverse = np.unique(self.hashes(data, st, en), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, uniq), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != uniq) if len(self.hash) else np.arange(len(uniq))
        if len(new):
            self._learn(data, st[first[new]], en[first[new]], uniq[new])
            at = np.searchsorted(self.hash, uniq)
        known = at[inverse]
        odd = self.length[known] != en - st
        same = np.flatnonzero(~odd)
        # equal hashes say nothing yet: the bytes must be equal
        odd[same] = differing(data, st[same], self.bytes, self.at[known[same]], self.length[known[same]])
        sizes, starts, pool = self.size[known], self.start[known], self.pool
        odd = np.flatnonzero(odd)
        if len(odd):
            flat, own = self._flat(data, st[odd], en[odd])
            sizes[odd], starts[odd] = own, len(pool) + np.cumsum(own) - own
            pool = np.concatenate([pool, flat])
        return pool[tx.ragged(starts, sizes)], sizes
