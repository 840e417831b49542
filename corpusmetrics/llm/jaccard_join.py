"""Exact Jaccard join on word shingles by size-banded tiles with hashed bitmaps.

1. Documents of equal sets become one class, for which the least of them speaks: of the
   others only the name of their set travels.
2. A count-min sketch of the shingles of those that speak tells about how often each occurs.
   In the order "by class of count (1, 2+, 16+, 256+), then by hash", a document must share one
   of its first n - ceil(t n) + 1 shingles with every document it links to (prefix filtering);
   so a document whose prefix is single throughout has no links and nothing of it travels, and
   common passages seldom come into a prefix.  Classes that share a prefix shingle fall into
   one block; the sets of the classes in blocks are made anew from their texts.
3. Within a block, classes are dealt to tiles by bands of set sizes, in which a size
   is at most 1/t times the least.  Tiles meet only tiles of the same or the next band.
   The bit counts of hashed bitmaps bound the overlap of a pair from above; pairs that the
   bound leaves are settled by intersecting the sorted arrays, unless already connected.
4. The links found, a forest for each tile pair, are joined to components.

Shingles are 64-bit hashes.  No pair is lost at any size: a full sketch only lets more
prefixes pass, so its counters grow with the input; tasks look shingles up slice by slice.
Which documents speak, or stand in blocks, tasks ask a filter of at most 2**28 bits a row; those
that it lets pass in error are dropped by a join.

Defined results: null texts and texts without words have no shingles and link with
nothing; fewer words than ``k`` are one shingle; rows of null doc_id are taken as the
least id in joins and get component_id null if that id is theirs; rows of equal doc_id
are one node (its sets are linked); a similarity of exactly the share (a tie) links; very
long texts are whole sets, worked on alone; an empty table gives an empty result; columns
beyond doc_id and text, whatever their names, are not read.  The join gives components
and no number of links: pairs that are connected already are not compared.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .shared import NULL_ID, drop, stored, texts_of
from .sketch import Sliced, held, repeated_keys, sliced_keys

#: Counts from which a shingle is of the next class.
LEVELS = (2, 16, 256)
#: Classes of a tile, and bits of a bitmap.
TILE, BITMAP = 1024, 512
#: Small blocks are worked on together, about so many classes at once.
TOGETHER = 2000


def _shingles(col, k: int):
    """(first row, first shingle of each text, shingles of all texts), the shingles of a text distinct and ascending."""
    for i, j, data, off in tx.slices(tx.column(col)):
        st, en, first = tx.word_bounds(data, off)
        codes = tx.span_hashes(data, st, en, lower=True)
        n = np.diff(first)
        grams = tx.run_hashes(codes, k)
        own = np.repeat(np.arange(j - i), np.maximum(n - k + 1, 0))
        at = tx.ragged(first[:-1], np.maximum(n - k + 1, 0))
        keys = grams[at] if len(at) else np.zeros(0, np.uint64)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = np.array([int.from_bytes(hashlib.blake2b(codes[first[r] : first[r + 1]].tobytes(), digest_size=8).digest(), "big") for r in short], np.uint64)
            own, keys = np.concatenate([own, short]), np.concatenate([keys, whole])
        order = np.lexsort((keys, own))
        own, keys = own[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])
        own, keys = own[new], keys[new]
        yield i, np.searchsorted(own, np.arange(j - i + 1)), keys


def _doc_keys(doc: pa.Array) -> np.ndarray:
    return tx.mix(doc.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _chosen(nodes: DataFrame, count: int):
    """A broadcast filter of the column node: all of its values pass, and few others."""
    return repeated_keys(nodes.select("node"), lambda batch: iter([_doc_keys(batch.column("node"))]), count, levels=(1,))


def _passed(batches, sent):
    """The rows of batches whose doc passes the filter."""
    for batch in batches:
        yield batch.filter(pa.array(held(sent).repeated(_doc_keys(batch.column("doc")))))


def _keys(k: int, sent):
    def run(batch):
        for own in _passed([batch], sent):
            for _, _, keys in _shingles(own.column("text"), k):
                yield keys

    return run


def needed(n: int, share: int) -> int:
    """Least overlap of a set of n with one it links to."""
    return -(-share * n // 100)


def _name(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _names(k: int):
    """doc, n, name of every row: the size and the digest of its set."""

    def run(batches):
        for batch in tx.small(batches):
            sizes, names = [], []
            for _, first, keys in _shingles(batch.column("text"), k):
                sizes.append(np.diff(first))
                names += [_name(keys[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            n = pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), n, pa.array(names, pa.binary())], names=["doc", "n", "name"])

    return run


def _prefixes(k: int, share: int, sketch: Sliced, sent):
    """node, n, name, prefix of the rows that pass and may have links."""

    def rows(held: list) -> pa.RecordBatch:
        """The rows of batches (doc, first and keys of each slice), all looked up at once."""
        level = sketch.level(np.concatenate([keys for _, own in held for _, keys in own] or [np.zeros(0, np.uint64)]))
        docs, sizes, names, prefixes, at = [], [], [], [], 0
        for doc, slices in held:
            row = 0
            for first, keys in slices:
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    n, own, high = b - a, keys[a:b], level[at + a : at + b]
                    length = n - needed(n, share) + 1 if n else 0
                    single = int((high == 0).sum())
                    if single < length:
                        docs.append(doc[row].as_py())
                        sizes.append(n)
                        names.append(_name(own))
                        prefixes.append(own[np.argsort(high, kind="stable")[single:length]].view(np.int64))
                    row += 1
                at += len(keys)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["node", "n", "name", "prefix"])

    def run(batches):
        held, n = [], 0
        for batch in tx.small(_passed(batches, sent)):
            own = [(first, keys) for _, first, keys in _shingles(batch.column("text"), k)]
            held.append((batch.column("doc"), own))
            n += sum(len(keys) for _, keys in own)
            if n >= sketch.together:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return run


def _bodies(k: int, sent):
    """node, name, body of the rows that pass: their sets."""

    def run(batches):
        for batch in tx.small(_passed(batches, sent)):
            doc = batch.column("doc")
            for i, first, keys in _shingles(batch.column("text"), k):
                sets = [keys[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc.slice(i, len(sets)), pa.array(list(map(_name, sets)), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "name", "body"])

    return run


def _bitmaps(bodies: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(bodies), BITMAP // 64), np.uint64)
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    flat = np.concatenate(bodies)
    row = np.repeat(np.arange(len(bodies)), size)
    bit = (flat & np.uint64(BITMAP - 1)).astype(np.int64)
    np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= share * (len(a) + len(b) - both)


def tile_links(nodes: np.ndarray, bodies: list[np.ndarray], cross: int, share: int) -> tuple[list[int], list[int]]:
    """A forest of the links among the sets (cross = 0), or between the first ``cross`` sets and the others."""
    n = np.fromiter(map(len, bodies), np.int64, len(bodies))
    maps = _bitmaps(bodies)
    ones = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    root = list(range(len(bodies)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out_a, out_b = [], []
    for i in range(1, len(bodies)) if not cross else range(cross, len(bodies)):
        j = np.arange(i) if not cross else np.arange(cross)
        j = j[(100 * np.minimum(n[j], n[i]) >= share * np.maximum(n[j], n[i]))]
        if not len(j):
            continue
        # bits of one bitmap that the other lacks stand for at least as many elements that the other lacks
        common = np.bitwise_count(maps[j] & maps[i]).sum(axis=1).astype(np.int64)
        most = np.minimum(n[j] - (ones[j] - common), n[i] - (ones[i] - common))
        pick = 100 * most >= share * (n[j] + n[i] - most)
        for x in j[pick][np.argsort(-most[pick], kind="stable")].tolist():
            a, b = find(x), find(i)
            if a != b and _linked(bodies[x], bodies[i], share):
                root[max(a, b)] = min(a, b)
                out_a.append(int(nodes[x]))
                out_b.append(int(nodes[i]))
    return out_a, out_b


def _tiles(share: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        pdf = pdf.sort_values(["block", "side", "n", "node"], kind="stable")
        block, node, side = pdf["block"].to_numpy(), pdf["node"].to_numpy(), pdf["side"].to_numpy()
        bodies = [np.frombuffer(b, np.uint64) for b in pdf["body"]]
        edges = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            second = int((side[lo:hi] == 1).sum())
            cross = hi - lo - second if second else 0
            if hi - lo > 1 and (not second or cross):
                a, b = tile_links(node[lo:hi], bodies[lo:hi], cross, share)
                out_a += a
                out_b += b
        del pdf, bodies
        tx.release()
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})

    return run


def set_links(classes: DataFrame, docs: DataFrame, k: int, share: int) -> DataFrame:
    """a, b: forests of the links of ``classes`` (node, name, n, prefix) of ``docs`` (doc, text).

    All planning is done on narrow rows; only the sets of blocks are made, and move once to their rows and once to their tiles.
    """
    tokens = classes.select("node", F.explode("prefix").alias("token"))
    least = tokens.groupBy("token").agg(F.min("node").alias("m"), F.count("*").alias("c")).where("c > 1").select("token", "m")
    star = tokens.join(least, "token").where("node > m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    blocks = stored(components(star), "blocks")  # node, root
    member = blocks.unionByName(blocks.select(F.col("root").alias("node"), "root").distinct()).select("node", F.col("root").alias("block"))
    rows = classes.select("node", "name", "n").join(member, "node")
    # size bands: ratio 100 / share
    rows = stored(rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / share)).cast("long")), "blocked")
    per_block = rows.groupBy("block").agg(F.count("*").alias("size"))
    count = rows.count()
    groups = max(1, count // TOGETHER)
    # bodies of other sets of an equal doc_id are dropped by the join
    sent = _chosen(rows, count)
    bodies = docs.mapInArrow(tx.task(_bodies(k, sent)), "node long, name binary, body binary").dropDuplicates(["node", "name"])
    small = rows.join(per_block.where(F.col("size") <= TILE).select("block"), "block")
    small = small.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("k1"), *(F.lit(0).cast("long").alias(k) for k in ("k2", "k3", "k4", "k5")), F.lit(0).alias("side"), "block", "node", "name", "n")
    large = rows.join(per_block.where(F.col("size") > TILE).select("block"), "block")
    per_band = large.groupBy("block", "band").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    large = large.join(per_band, ["block", "band"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    upper = per_band.select("block", (F.col("band") - 1).alias("band"), F.col("tiles").alias("above"))
    lower = per_band.select("block", (F.col("band") + 1).alias("band"), F.col("tiles").alias("below"))
    large = large.join(upper, ["block", "band"], "left").join(lower, ["block", "band"], "left").na.fill(0, ["above", "below"])
    one = "named_struct('k2', {}, 'k3', {}, 'k4', {}, 'k5', {}, 'side', {})"
    places = F.expr(
        "concat("
        f"transform(sequence(0L, tiles - 1), t -> {one.format('band', 'least(tile, t)', 'band', 'greatest(tile, t)', 'if(tile <= t, 0, 1)')}),"
        f"if(above > 0, transform(sequence(0L, greatest(above, 1L) - 1), t -> {one.format('band', 'tile', 'band + 1', 't', '0')}), array()),"
        f"if(below > 0, transform(sequence(0L, greatest(below, 1L) - 1), t -> {one.format('band - 1', 't', 'band', 'tile', '1')}), array()))"
    )
    large = large.select("block", "node", "name", "n", F.explode(places).alias("p"))
    large = large.select(F.col("block").alias("k1"), *(F.col(f"p.{c}") for c in ("k2", "k3", "k4", "k5", "side")), "block", "node", "name", "n")
    placed = small.unionByName(large).join(bodies, ["node", "name"]).drop("name")
    return placed.groupBy("k1", "k2", "k3", "k4", "k5").applyInPandas(_tiles(share), "a long, b long")


def shingle_components(docs: DataFrame, k: int, share: int) -> DataFrame:
    """doc (null as NULL_ID), n, root: the least doc of its component."""
    docs = texts_of(docs)
    docs = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text")
    sets = stored(docs.mapInArrow(tx.task(_names(k)), "doc long, n long, name binary"), "sets")
    named = stored(sets.where("n > 0").groupBy("n", "name").agg(F.min("doc").alias("node")), "named")
    speakers, shingles = named.agg(F.count("*"), F.sum("n")).first()
    sent = _chosen(named, speakers)
    counts = sliced_keys(docs, _keys(k, sent), 1.25 * (shingles or 0), levels=LEVELS)
    found = stored(docs.mapInArrow(tx.task(_prefixes(k, share, counts, sent)), "node long, n long, name binary, prefix array<long>"), "prefixes")
    counts.destroy()
    sent.destroy()
    # one row of a class speaks for it
    classes = found.join(named, ["node", "n", "name"]).groupBy("node", "name", "n").agg(F.first("prefix").alias("prefix"))
    # written before they are joined: a task with two Python steps has two workers at once, and both stay
    links = stored(set_links(classes, docs, k, share), "pairs")
    drop(found)
    copies = sets.where("n > 0").join(named, ["n", "name"]).where("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    roots = components(links.unionByName(copies))
    drop(links)
    out = sets.select("doc", "n").join(roots, F.col("doc") == F.col("node"), "left")
    return out.select("doc", "n", F.coalesce("root", "doc").alias("root"))


def jaccard_join(docs: DataFrame, k: int = 5, share: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links of at least share/100)."""
    out = shingle_components(docs, k, share)
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("root") != NULL_ID, F.col("root")).alias("component_id"))


def jaccard_survivors(docs: DataFrame, k: int = 5, share: int = 75) -> DataFrame:
    """The rows of ``docs``, whole, whose doc_id is the least of its component."""
    gone = shingle_components(docs, k, share).where("doc <> root").select(F.col("doc").alias("__doc")).distinct()
    rows = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return rows.join(gone, "__doc", "left_anti").drop("__doc")
