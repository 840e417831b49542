"""Exact, window, suffix and Jaccard deduplication against plain versions."""

from collections import defaultdict

import brute
import numpy as np
import pytest

from corpusmetrics.llm import exact_dedup as E
from corpusmetrics.llm import graph, repeats, sketch, suffix_dedup
from corpusmetrics.llm import text as tx
from corpusmetrics.llm.jaccard_join import jaccard_join, jaccard_survivors
from corpusmetrics.llm.suffix_dedup import suffix_deduped
from corpusmetrics.llm.window_dedup import window_dedup


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact(docs, pairs, digest_bytes):
    groups = defaultdict(list)
    for d, t in pairs:
        groups[(t or "").translate(brute.AZ)].append(d)
    want = sorted(((d, max(ds), len(ds), d == max(ds), brute.sha(t.encode())) for t, ds in groups.items() for d in ds), key=str)
    assert rows(E.exact_dedup(docs, digest_bytes)) == want


def test_exact_survivors(docs, pairs, odd, empty):
    kept = E.exact_survivors(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in E.exact_dedup(docs).where("kept").collect()}
    assert E.exact_survivors(odd).count() == 3
    assert E.exact_survivors(empty).count() == 0
    assert E.exact_dedup(odd).count() == 6


def test_chunks_cover_texts_and_are_bounded():
    data = np.random.default_rng(0).integers(97, 100, 200_000, dtype=np.uint8)
    data[50_000:100_000] = 97  # nothing to cut at
    off = np.array([0, 10, 10, 120_000, 200_000])
    ends = E.chunk_ends(data, off)
    assert set(off[1:]) <= set(ends.tolist()) and np.diff(np.concatenate([[0], ends])).max() <= E.LONGEST
    alone = E.chunk_ends(data[120_000:], np.array([0, 80_000])) + 120_000
    assert alone.tolist() == ends[ends > 120_000].tolist()


@pytest.mark.parametrize("width", [50, 9])
def test_windows(docs, pairs, width):
    assert rows(window_dedup(docs, width, digest=True)) == sorted(brute.window_dedup(pairs, width), key=str)


def test_windows_of_odd_rows(odd, empty):
    got = rows(window_dedup(odd))
    assert len(got) == 6 and window_dedup(empty).count() == 0
    # the null ids come first, so the rows of id 5 lose what the null rows hold
    assert sorted(g[2] for g in got if g[0] == 5) == [150, 150, 150]
    assert all(g[2] == 0 for g in got if g[0] is None)


@pytest.mark.parametrize("depth", [100, 40])
def test_suffixes(docs, pairs, depth):
    assert rows(suffix_dedup.suffix_dedup(docs, depth)) == sorted(brute.suffix_dedup(pairs, depth), key=str)


def test_suffix_blocks_of_any_size(docs, pairs, monkeypatch):
    want = sorted(brute.suffix_dedup(pairs, 100), key=str)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1)
    assert rows(suffix_dedup.suffix_dedup(docs, 100)) == want


def test_suffix_texts(docs, pairs, odd, empty):
    out = suffix_deduped(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    plain = {r[0]: r for r in brute.suffix_dedup(pairs, 100)}
    for d, t in pairs:
        if plain[d][2] == 0:
            assert kept[d]["text"] == (t or "")
        assert kept[d]["n_chars"] == len(kept[d]["text"])
        assert len(kept[d]["text"].encode()) <= plain[d][1] - plain[d][2]
    assert suffix_deduped(odd).count() == 6 and suffix_deduped(empty).count() == 0


def test_cover_and_order():
    cover = suffix_dedup.difference_cover(32, 8)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))
    rng = np.random.default_rng(1)
    bodies = [bytes(rng.integers(97, 99, rng.integers(60, 90), dtype=np.uint8)) for _ in range(40)]
    bodies += [b[:30] + b"!" + b[31:] for b in bodies] + bodies[:5]
    back = np.full(len(bodies), 20)
    own, start, kind = suffix_dedup.equal_strings(bodies, back, np.zeros(len(bodies), int), 40)
    seen: dict = {}
    for o, s, k in zip(own.tolist(), start.tolist(), kind.tolist(), strict=True):
        assert seen.setdefault((s, bodies[o][s : s + 40]), k) == k
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("tile", [1024, 4])
def test_jaccard(docs, pairs, tile, monkeypatch):
    from corpusmetrics.llm import jaccard_join as J

    monkeypatch.setattr(J, "TILE", tile)
    assert rows(jaccard_join(docs)) == sorted(brute.jaccard_join(pairs), key=str)


def test_jaccard_keeps_nothing_of_copies(spark, monkeypatch):
    """Every text six times: no shingle is single, but neither sets nor prefixes of texts without near copies are written."""
    from corpusmetrics.llm import jaccard_join as J

    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    near = [t.replace("x29", "y29") for t in texts[:2]]
    rows_in = [(c * 100 + i, t) for c in range(6) for i, t in enumerate(texts + near)]
    written = []

    def noted(df, name):
        out = stored(df, name)
        if "prefix" in out.columns or "body" in out.columns:
            written.append(out.count() if "body" not in out.columns else out.where("body IS NOT NULL").count())
        return out

    stored = J.stored
    monkeypatch.setattr(J, "stored", noted)
    got = rows(jaccard_join(spark.createDataFrame(rows_in, "doc_id long, text string").repartition(5)))
    assert got == sorted(brute.jaccard_join(rows_in), key=str)
    assert sum(written) <= 4


def test_jaccard_survivors(docs, pairs, odd, empty):
    kept = jaccard_survivors(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, c in brute.jaccard_join(pairs) if d == c}
    assert jaccard_join(odd).count() == 6 and jaccard_join(empty).count() == 0
    assert jaccard_survivors(odd).count() == 3  # the rows of null id come first and are one node


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_never_misses(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 5000, dtype=np.int64)
    df = spark.createDataFrame([(int(k),) for k in np.concatenate([keys, keys[:2000], keys[:300], keys[:300]])], "k long").repartition(5)

    def keys_of(batch):
        yield tx.mix(batch.column("k").to_numpy().astype(np.uint64))

    s = sketch.held(sketch.repeated_keys(df, keys_of, 8000, levels=(2, 4)))
    level = s.level(tx.mix(keys.astype(np.uint64)))
    assert (level[:2000] >= 1).all() and (level[:300] == 2).all() and (level[2000:] == 0).mean() > 0.99


def test_anchors_are_functions_of_content():
    rng = np.random.default_rng(3)
    seq = tx.mix(rng.integers(0, 50, 500).astype(np.uint64))
    whole = repeats.anchors(seq, np.array([0, 500]), 20, 4)
    part = repeats.anchors(seq[100:300], np.array([0, 200]), 20, 4)
    at = {w: a for a, f, c in zip(whole.at, whole.first, whole.count, strict=True) for w in range(f, f + c)}
    assert sorted(at) == list(range(481))
    for a, f, c in zip(part.at, part.first, part.count, strict=True):
        assert all(at[w + 100] == a + 100 for w in range(f, f + c))
    assert len(repeats.anchors(seq, np.array([0, 15, 500]), 20, 4).at) > 0
    assert repeats.anchors(seq[:10], np.array([0, 10]), 20, 4).at.size == 0
