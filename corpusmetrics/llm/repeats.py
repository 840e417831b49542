"""Windows of a sequence by their anchors.

The anchor of a window is its gram (a short run of elements) of least hash, the
leftmost of equals.  Equal windows have equal anchors at equal distances, so windows
can be counted and grouped by anchors, of which there are far fewer.

An anchor that occurs very often, in contexts that differ, would bring all of them to one task.
Its windows are therefore dealt by their distance from it, STEP distances at a time, and by
a hash of what all windows of those distances share: equal windows still meet, and
what meets is alike but for the outermost elements.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import text as tx

#: An anchor is dealt by its contexts from so many occurrences on, and so many distances together.
OFTEN, STEP = 512, 8
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


class Anchors(NamedTuple):
    key: np.ndarray  # hash of the anchor gram
    at: np.ndarray  # its first element
    first: np.ndarray  # first window it anchors
    count: np.ndarray  # windows in a row that it anchors


def anchors(codes: np.ndarray, off: np.ndarray, width: int, gram: int) -> Anchors:
    """``off``: first element of each document, and the end.  Windows lie wholly within documents."""
    n = len(codes) - width + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(np.zeros(0, np.uint64), empty, empty, empty)
    grams = tx.Rolling(codes).windows(gram, salt=1)
    least = tx.sliding_min((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    change = np.zeros(n + 1, np.int32)
    ends = off[1:]
    np.add.at(change, np.maximum(0, np.minimum(n, ends - width + 1)), 1)
    np.add.at(change, np.minimum(n, ends), -1)
    # a document shorter than a window blocks the windows that reach it more than once
    valid = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    if not len(valid):
        return Anchors(np.zeros(0, np.uint64), empty, empty, empty)
    at = (least[valid] & _LOW).astype(np.int64)
    head = np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    starts = np.flatnonzero(head)
    count = np.diff(np.append(starts, len(valid)))
    at = at[starts]
    return Anchors(grams[at], at, valid[starts], count)


def dealt(a: Anchors, often: np.ndarray, shared) -> Anchors:
    """``a`` with the runs of anchors that occur ``often`` cut, and their keys dealt.  ``shared``: hashes of the elements that windows of one cut share, by its first."""
    if not often.any():
        return a
    rest = Anchors(*(x[~often] for x in a))
    key, at, first, count = (x[often] for x in a)
    run = np.repeat(np.arange(len(at)), count)
    window = tx.ragged(first, count)
    group = (at[run] - window) // STEP
    head = np.flatnonzero(group_heads(run, group))
    run, group = run[head], group[head]
    key = tx.mix(tx.mix(key[run] + group.astype(np.uint64)) ^ shared(at[run] - STEP * group))
    cut = Anchors(key, at[run], window[head], np.diff(np.append(head, len(window))))
    both = [np.concatenate([x, y]) for x, y in zip(rest, cut, strict=True)]
    order = np.argsort(both[2], kind="stable")
    return Anchors(*(x[order] for x in both))


def group_heads(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    out = np.zeros(len(keys[0]), bool)
    out[0] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out
