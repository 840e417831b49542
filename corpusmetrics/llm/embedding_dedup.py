"""Near-duplicate vectors by p-stable hashing, then exact cosines.

Vectors are normalised and hashed by floor((a x + b) / w) with Gaussian a, k such values
to a key, in several tables.  k grows with the logarithm of the number of vectors, so
unrelated vectors seldom meet, and the number of tables follows from the recall wanted
for a pair exactly at the threshold (closer pairs have more).  A sketch drops keys that
stand alone before anything is shuffled.  Vectors that meet in a bucket are compared
exactly, in tiles when the bucket is large, and a forest of the links found gives the
components; within them all pairs of tiles are compared once more, for exact link counts.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different length never link; equal vectors are one class
and link with each other; rows of equal vec_id are one node; a null vec_id is a node of
its own and gives a null component_id; a cosine of exactly the threshold (a tie) links; very
long vectors are worked on by parts of few rows; an empty table gives an empty result;
columns beyond vec_id and embedding, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components, forest
from .shared import NULL_ID, stored
from .sketch import held, repeated_keys

#: Width of the quantisation, in units of the normalised space.
WIDTH = 2.0
SEED = 20_11
#: Vectors of a tile; small groups are worked on together, about so many vectors at once.
TILE, TOGETHER = 1024, 4000


def meet(distance: float) -> float:
    """Probability that one hash value of two vectors at this distance is equal."""
    c = WIDTH / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Values to a key and tables, for n vectors: a vector meets 0.05 unrelated ones a table."""
    near, far = meet(math.sqrt(2 - 2 * cosine)), meet(math.sqrt(2))
    k = max(4, math.ceil(math.log(20 * max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def bucket_keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Keys of the normalised rows of x: one column a table."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    a = rng.standard_normal((x.shape[1], tables * k)).astype(np.float32)
    b = rng.uniform(0, WIDTH, tables * k).astype(np.float32)
    out = np.empty((len(x), tables), np.uint64)
    salt = tx.mix(np.arange(tables, dtype=np.uint64) + np.uint64(x.shape[1] << 32))
    for i in range(0, len(x), 1000):
        q = np.floor((x[i : i + 1000].astype(np.float32) @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(-1, tables, k)
        h = np.broadcast_to(salt, q.shape[:2]).copy()
        for j in range(k):
            h = tx.mix(h + q[:, :, j])
        out[i : i + 1000] = h
    return out


def _unit(blobs) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, normalised rows) for each length among binary float64 vectors."""
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = np.frombuffer(b"".join(blobs[i] for i in at), np.float64).reshape(-1, d)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def _binary(batches):
    """Vectors as the bytes of their doubles; null where a vector links with nothing."""
    for batch in tx.small(batches):
        col = batch.column("embedding").cast(pa.large_list(pa.float64()))
        size = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
        x = col.flatten().to_numpy(zero_copy_only=False) + 0.0  # null components become NaN, negative zeros zeros
        ends = np.cumsum(size)
        count = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])  # noqa: B023, E731
        ok = (size > 0) & (count(~np.isfinite(x)) == 0) & (count(x != 0) > 0)
        off = 8 * np.concatenate([[0], ends]).astype(np.int64)
        vec = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [pa.py_buffer(np.packbits(ok, bitorder="little").tobytes()), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(x))])
        yield pa.RecordBatch.from_arrays([batch.column("id"), vec.cast(pa.binary())], names=["id", "vec"])


def _keys(k: int, tables: int):
    def run(batch):
        for _, x in _unit(batch.column("vec").to_pylist()):
            yield bucket_keys(x, k, tables).ravel()

    return run


def _members(k: int, tables: int, sent):
    def run(batches):
        sketch = held(sent)
        for batch in tx.small(batches):
            blobs, node = batch.column("vec").to_pylist(), batch.column("node").to_numpy()
            for at, x in _unit(blobs):
                for i in range(0, len(at), 2000):
                    keys = bucket_keys(x[i : i + 2000], k, tables)
                    row, col = np.nonzero(sketch.repeated(keys.ravel()).reshape(keys.shape))
                    rows = at[i + row]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row, col].view(np.int64)), pa.array(node[rows]), pa.array([blobs[r] for r in rows], pa.binary())], names=["bucket", "node", "vec"])

    return run


def tiled(rows: DataFrame, group: str) -> DataFrame:
    """rows with keys k1, k2, k3 of the task that compares them, and side (1: second tile of two)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__size")).where("__size > 1")
    rows = rows.join(sizes, group).withColumn("__tiles", F.ceil(F.col("__size") / TILE).cast("long"))
    rows = rows.withColumn("__tile", F.pmod(F.xxhash64("node"), F.col("__tiles")))
    groups = max(1, rows.count() // TOGETHER)
    pairs = F.expr(
        f"if(__tiles = 1, array(named_struct('k1', pmod(xxhash64({group}), {groups}L), 'k2', -1L, 'k3', -1L, 'side', 0)), "
        f"transform(sequence(0L, __tiles - 1), t -> named_struct('k1', {group}, 'k2', least(__tile, t), 'k3', greatest(__tile, t), 'side', if(__tile <= t, 0, 1))))"
    )
    return rows.select("*", F.explode(pairs).alias("__p")).select(*(F.col(f"__p.{c}") for c in ("k1", "k2", "k3", "side")), *[c for c in rows.columns if not c.startswith("__")])


def _groups(pdf: pd.DataFrame, group: str):
    """(first row, end row, rows of the first tile or 0) of each group of two or more."""
    g, side = pdf[group].to_numpy(), pdf["side"].to_numpy()
    edges = np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        second = int((side[lo:hi] == 1).sum())
        same_tile = int(pdf["k2"].iat[lo]) == int(pdf["k3"].iat[lo])
        if hi - lo > 1 and (same_tile or 0 < second < hi - lo):
            yield lo, hi, 0 if same_tile else hi - lo - second


def _rows_of(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    blobs = pdf["vec"].tolist()
    place: list = [None] * len(blobs)
    for at, x in _unit(blobs):
        for i, r in zip(at.tolist(), x, strict=True):
            place[i] = r
    return place


def _near(x: list[np.ndarray], cross: int, cosine: float):
    """(i, j) of all linked pairs among the rows, or between the first ``cross`` and the others; by blocks of rows."""
    dims = np.array([len(r) for r in x])
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        m = np.stack([x[i] for i in own])
        a = own[own < cross] if cross else own
        b = own[own >= cross] if cross else own
        ma, mb = m[: len(a)] if cross else m, m[len(a) :] if cross else m
        for i in range(0, len(a), 512):
            r, c = np.nonzero(ma[i : i + 512] @ mb.T >= cosine)
            r += i
            if not cross:
                r, c = r[r < c], c[r < c]
            yield a[r], b[c]


def _forest(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "side"], kind="stable").reset_index(drop=True)
        node, x = pdf["node"].to_numpy(), _rows_of(pdf)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi, cross in _groups(pdf, "bucket"):
            found = [np.concatenate(p) for p in zip(*_near(x[lo:hi], cross, cosine), strict=True)]
            if found and len(found[0]):
                a, b = forest(node[lo + found[0]], node[lo + found[1]])
                out_a.append(a)
                out_b.append(b)
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _counts(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root", "side"], kind="stable").reset_index(drop=True)
        node, copies, x = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), _rows_of(pdf)
        links = np.zeros(len(pdf), np.int64)
        for lo, hi, cross in _groups(pdf, "root"):
            for a, b in _near(x[lo:hi], cross, cosine):
                np.add.at(links, lo + a, copies[lo + b])
                np.add.at(links, lo + b, copies[lo + a])
        return pd.DataFrame({"node": node, "links": links})

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.92) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id, kept."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), "embedding")
    rows = stored(rows.mapInArrow(_binary, "id long, vec binary"), "vectors")
    classes = stored(rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "classes")
    n = classes.count()
    k, tables = plan(n, cosine, recall)
    sent = repeated_keys(classes.select("vec"), _keys(k, tables), n * tables, rows=1)
    members = stored(classes.select("node", "vec").mapInArrow(_members(k, tables, sent), "bucket long, node long, vec binary"), "members")
    links = tiled(members, "bucket").groupBy("k1", "k2", "k3").applyInPandas(_forest(cosine), "a long, b long")
    roots = components(links)
    roots = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    grouped = classes.join(roots, "node").select("root", "node", "vec", "copies")
    counts = tiled(grouped, "root").groupBy("k1", "k2", "k3").applyInPandas(_counts(cosine), "node long, links long")
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(roots, "node", "left").join(counts, "node", "left")
    known = known.select("vec", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(known, "vec", "left").select(F.col("id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("root"))
    real = [F.when(F.col(c) != NULL_ID, F.col(c)) for c in ("id", "root")]
    return out.select(real[0].alias("vec_id"), "n_links", real[1].alias("component_id"), (F.col("id") == F.col("root")).alias("kept"))
