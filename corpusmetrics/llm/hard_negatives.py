"""Hard negatives by dual-tree search over anchors and candidates.

Components become integers, so scores are exact.  A binary tree of balls, split on a bounded sample
(at most SAMPLE_BYTES of vectors), routes every row to a leaf; the centres are those of the sample,
the radii cover all rows.  The same tree holds the anchors and the candidates, each with radii of
its own.  For two nodes with centres a, c and radii r, s every inner product lies within
a.c +- (|a| s + |c| r + r s): a pair of nodes goes, with all anchors below it, if that interval
misses what the anchors still need.  What they need comes from their own leaves first (the k-th best
score there) and, for negatives, from the band that the positive allows.  The traversal works on
nodes only, whose number is bounded.  Rows lie in blocks of bounded size, one row of a table each,
with balls of their own; a task gets some blocks and a group of anchors, discards (leaf of anchors,
block) pairs by the same intervals, and scores the others as matrix products.

Defined results: rows with a null label, a null vector, or any null or non-finite component take no
part; vectors of different length never meet; an empty vector scores 0 with others; a null vec_id
comes before all others at ties and is no anchor unless the given condition holds for it; repeated rows are rows of their own, so an anchor may have
its copy as a positive, and each anchor row gives its own result; equal scores (ties) go by smaller vec_id;
a positive score below zero has an empty band and gives no rows; scores beyond 64 bits are
held at the limit; vectors of any length are worked on in smaller blocks; an empty table
gives an empty result; columns beyond vec_id, embedding and label, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import NULL_ID, stored

#: Candidates of a block at most, and its bytes; anchors of a group; blocks of a task.
BLOCK, BLOCK_BYTES, GROUP, TOGETHER = 1024, 4_000_000, 1024, 16
#: Rows of a leaf that the tree aims at, its leaves at most (also bounded by the bytes of their centres), sampled rows a leaf, bytes of the sample.
LEAF, MOST_LEAVES, PER_LEAF, SAMPLE_BYTES = 4096, 1024, 16, 64_000_000
#: Tasks that share the rows of one leaf.
SPREAD = 64
#: Anchors of so many levels of leaves go to one group.
LIFT = 3
NONE, MOST = -(2**63), 2**63 - 1
#: Bounds are widened by this share, against rounding.
SLACK = 1e-9


def _widest_cut(along: np.ndarray) -> float:
    """Where two parts of the values have the largest variance between them."""
    v = np.sort(along)
    if len(v) < 2:
        return 0.0
    n, total = np.arange(1, len(v)), np.cumsum(v)
    apart = n * (len(v) - n) * (total[:-1] / n - (total[-1] - total[:-1]) / (len(v) - n)) ** 2
    k = int(np.argmax(apart))
    return float((v[k] + v[k + 1]) / 2)


class Tree:
    """A complete binary tree of balls in heap order: node i has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(leaves).bit_length() - 1)
        n = 2 ** (self.depth + 1) - 1
        self.centre = np.zeros((n, sample.shape[1]))
        self.axis = np.zeros((n // 2, sample.shape[1]))
        self.cut = np.zeros(n // 2)
        held = {0: sample}
        for i in range(n):
            x = held.pop(i)
            self.centre[i] = x.mean(axis=0) if len(x) else self.centre[(i - 1) // 2]
            if i < n // 2:
                spread = x - self.centre[i]
                axis = np.ones(x.shape[1])
                for _ in range(8):  # towards the main direction
                    axis = spread.T @ (spread @ axis)
                    axis /= max(np.linalg.norm(axis), 1e-300)
                along = x @ axis
                self.axis[i], self.cut[i] = axis, _widest_cut(along)
                right = along > self.cut[i]
                held[2 * i + 1], held[2 * i + 2] = x[~right], x[right]

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node of each row at each level, root first."""
        out = np.zeros((len(x), self.depth + 1), np.int64)
        for k in range(self.depth):
            at = out[:, k]
            out[:, k + 1] = 2 * at + 1 + ((x * self.axis[at]).sum(axis=1) > self.cut[at])
        return out


def _quantised(scale: int):
    def run(batches):
        """Integer components as the bytes of doubles; null where a row takes no part."""
        for batch in tx.small(batches):
            col = batch.column("embedding").cast(pa.large_list(pa.float64()))
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
            x = col.flatten().to_numpy(zero_copy_only=False) + 0.0  # null components become NaN
            ends = np.concatenate([[0], np.cumsum(size)])
            bad = np.diff(np.concatenate([[0], np.cumsum(~np.isfinite(x))])[ends]) > 0
            ok = ~bad & col.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(scale * x), -np.finfo(float).max, np.finfo(float).max) + 0.0
            vec = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [pa.py_buffer(np.packbits(ok, bitorder="little").tobytes()), pa.py_buffer(8 * ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("anchor"), vec.cast(pa.binary())], names=["id", "label", "anchor", "vec"])

    return run


def _matrix(blobs, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), d) if d else np.zeros((len(blobs), 0))


def _by_length(batch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    blobs = batch.column("vec").to_pylist()
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
    return [(int(d), at, _matrix([blobs[i] for i in at], d)) for d in np.unique(size) for at in [np.flatnonzero(size == d)]]


def _routed(trees: dict[int, Tree]):
    def run(batches):
        """The rows with the length of their vectors and their leaves."""
        for batch in tx.small(batches):
            dims, leaf = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for d, at, x in _by_length(batch):
                dims[at] = d
                if d in trees:
                    leaf[at] = trees[d].nodes(x)[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(leaf)], names=[*batch.schema.names, "d", "leaf"])

    return run


def _radii(trees: dict[int, Tree]):
    def run(batches):
        """Largest distance of the rows of a batch to the centre of each node they lie in, of anchors apart."""
        for batch in tx.small(batches):
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            for d, at, x in _by_length(batch):
                if d not in trees:
                    continue
                nodes = trees[d].nodes(x)
                far = np.stack([np.sqrt(((x - trees[d].centre[nodes[:, k]]) ** 2).sum(axis=1)) for k in range(nodes.shape[1])], axis=1)
                for side in (False, True):
                    rows = anchor[at] if side else np.ones(len(at), bool)
                    most = np.full(len(trees[d].centre), -1.0)
                    np.maximum.at(most, nodes[rows].ravel(), far[rows].ravel())
                    own = np.flatnonzero(most >= 0)
                    yield pa.RecordBatch.from_pydict({"d": np.full(len(own), d), "anchor": np.full(len(own), side), "node": own, "radius": most[own]})

    return run


def _packed(rows: pa.Table) -> pa.Table:
    """The rows of a block as one row: ids in order, labels, numbers of the rows, matrix."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    first = {c: [rows.column(c)[0].as_py()] for c in ("d", "leaf", "salt")}
    body = {c: [rows.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("id", "label", "row")}
    return pa.table(first | body | {"vecs": [b"".join(rows.column("vec").to_pylist())]}).cast(_BLOCK_SCHEMA)


_BLOCK_SCHEMA = pa.schema([("d", pa.int64()), ("leaf", pa.int64()), ("salt", pa.int64()), ("id", pa.binary()), ("label", pa.binary()), ("row", pa.binary()), ("vecs", pa.binary())])
_FOUND = "a_row long, slot int, score long, id long, row long"


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())


def interval(a: np.ndarray, r: float, c: np.ndarray, s: float) -> tuple[float, float]:
    """Bounds of the inner products of two balls."""
    with np.errstate(all="ignore"):
        mid, wide = float(a @ c), float(np.linalg.norm(a) * s + np.linalg.norm(c) * r + r * s)
        wide += SLACK * (abs(mid) + wide) + 1.0
        return mid - wide, mid + wide


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles are exact below 2**53, beyond that Python integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a @ x.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in a], [[int(v) for v in r] for r in x]
    return np.array([[min(MOST, max(NONE + 1, sum(p * q for p, q in zip(u, v, strict=True)))) for v in whole[1]] for u in whole[0]], np.int64)


def _search(k: int, same: bool):
    """The k best candidates of each anchor and slot: of its label or of others, with scores from need to cap."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[dict] = []
        if anchors.num_rows and blocks.num_rows:
            out = list(_found(anchors.sort_by("leaf"), blocks, k, same))
        names = ("a_row", "slot", "score", "id", "row")
        cols = {c: np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in names}
        return pa.table(cols | {"slot": cols["slot"].astype(np.int32)})

    return run


def _found(anchors: pa.Table, blocks: pa.Table, k: int, same: bool):
    d = anchors.column("d")[0].as_py()
    a = _matrix(anchors.column("vec").to_pylist(), d)
    row, label, leaf = (anchors.column(c).to_numpy() for c in ("row", "label", "leaf"))
    need, cap = (np.array(anchors.column(c).to_pylist(), np.int64) for c in ("need", "cap"))
    best = np.full((len(a), need.shape[1], k), NONE)  # scores, and below them ids and rows
    ids, rows = np.full_like(best, MOST), np.full_like(best, MOST)
    edges = np.append(np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])), len(a)).tolist()
    balls = [_ball(a[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
    for b in blocks.to_pylist():
        b_id, b_label, b_row = (np.frombuffer(b[c], np.int64) for c in ("id", "label", "row"))
        x = np.frombuffer(b["vecs"], np.float64).reshape(-1, d) if d else np.zeros((len(b_id), 0))
        ball = _ball(x)
        for (i, j), own in zip(zip(edges, edges[1:], strict=False), balls, strict=True):
            low, high = interval(*own, *ball)
            want = np.maximum(need[i:j], best[i:j, :, -1])
            if high < want.min() or low > cap[i:j].max():
                continue  # none of these anchors can gain from the block
            s = scores(a[i:j], x)
            fits = (label[i:j, None] == b_label) == same
            if same:
                fits &= row[i:j, None] != b_row
            s = np.where(fits, s, NONE)
            order = np.argsort(s[:, ::-1], axis=1, kind="stable")[:, ::-1]  # best first, ties by id: columns are in their order
            order = s.shape[1] - 1 - order
            s = np.take_along_axis(s, order, axis=1)
            first = np.stack([(s > cap[i:j, t, None]).sum(axis=1) for t in range(cap.shape[1])], axis=1)
            at = first[:, :, None] + np.arange(k)
            inside = at < s.shape[1]
            at = np.minimum(at, s.shape[1] - 1).reshape(len(s), -1)
            got = np.where(inside, np.take_along_axis(s, at, axis=1).reshape(inside.shape), NONE)
            ok = got >= np.maximum(need[i:j], NONE + 1)[:, :, None]
            pick = np.take_along_axis(order, at, axis=1).reshape(inside.shape)
            all_s = np.concatenate([best[i:j], np.where(ok, got, NONE)], axis=2)
            all_i = np.concatenate([ids[i:j], np.where(ok, b_id[pick], MOST)], axis=2)
            all_r = np.concatenate([rows[i:j], np.where(ok, b_row[pick], MOST)], axis=2)
            keep = np.lexsort((all_r, all_i, -(all_s + (all_s == NONE))), axis=-1)[..., :k]
            best[i:j], ids[i:j], rows[i:j] = (np.take_along_axis(v, keep, axis=2) for v in (all_s, all_i, all_r))
    at = np.nonzero(best > NONE)
    yield {"a_row": row[at[0]], "slot": at[1].astype(np.int64), "score": best[at], "id": ids[at], "row": rows[at]}


def _grown(rows: DataFrame, leaf: int) -> dict[int, Tree]:
    """A tree for each vector length in the sample."""
    total = rows.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("widest")).first()
    n, widest = total["n"], max(8, total["widest"] or 8)
    leaves = min(MOST_LEAVES, max(1, SAMPLE_BYTES // (4 * widest)), max(1, n // leaf))
    sample = rows.orderBy(F.xxhash64("vec", "row")).limit(max(1, min(PER_LEAF * leaves, SAMPLE_BYTES // widest))).select("vec").toArrow()
    return {d: Tree(x, max(1, leaves * len(x) // sample.num_rows)) for d, _, x in _by_length(sample.combine_chunks())} if sample.num_rows else {}


def surviving(tree: Tree, radius: dict[bool, np.ndarray], need: np.ndarray, cap: np.ndarray) -> list[tuple[int, int]]:
    """(leaf of anchors, leaf of candidates) that may give what is needed; the two trees are walked together from their roots.

    ``need`` and ``cap``: least need and largest cap of the anchors of each node.
    """
    out, todo, inner = [], [(0, 0)], len(tree.cut)
    while todo:
        a, c = todo.pop()
        if radius[True][a] < 0 or radius[False][c] < 0:
            continue  # nothing lies there
        low, high = interval(tree.centre[a], radius[True][a], tree.centre[c], radius[False][c])
        if high < need[a] or low > cap[a]:
            continue
        if a >= inner and c >= inner:
            out.append((a, c))
        elif c >= inner or (a < inner and radius[True][a] > radius[False][c]):
            todo += [(2 * a + 1, c), (2 * a + 2, c)]
        else:
            todo += [(a, 2 * c + 1), (a, 2 * c + 2)]
    return out


def _above(leaf: int) -> int:
    """The node LIFT levels above a leaf: its anchors go to tasks together."""
    for _ in range(LIFT):
        leaf = max(0, (leaf - 1) // 2)
    return leaf


def _spread(rows: DataFrame, sizes: DataFrame, *keys: str) -> DataFrame:
    """rows with what ``sizes`` says of their keys; the rows of one key are the work of SPREAD tasks."""
    sizes = sizes.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return rows.withColumn("spread", F.pmod(F.xxhash64("row"), F.lit(SPREAD).cast("long"))).join(sizes, [*keys, "spread"]).drop("spread")


class Search:
    """Rows in blocks and the trees over them."""

    def __init__(self, rows: DataFrame, leaf: int):
        self.spark = rows.sparkSession
        self.trees = _grown(rows, leaf)
        rows = stored(rows.mapInArrow(_routed(self.trees), "id long, label long, anchor boolean, vec binary, row long, d long, leaf long"), "routed")
        most = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("d") + 1))))
        sizes = rows.groupBy("d", "leaf").agg(F.ceil(F.count("*") / F.first(most)).alias("parts"))
        salted = _spread(rows, sizes, "d", "leaf").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")))
        blocks = salted.select("d", "leaf", "salt", "id", "label", "row", "vec").repartition("d", "leaf", "salt").groupBy("d", "leaf", "salt")
        self.blocks = stored(blocks.applyInArrow(_packed, "d long, leaf long, salt long, id binary, label binary, row binary, vecs binary"), "blocks")
        self.chunks = max(1, -(-self.blocks.count() // TOGETHER))
        self.anchors = stored(rows.where("anchor").select("id", "label", "vec", "row", "d", "leaf"), "anchors")
        self.planned = F.col("d").isin(list(self.trees)) if self.trees else F.lit(False)
        self.radius = {d: {s: np.full(len(t.centre), -1.0) for s in (False, True)} for d, t in self.trees.items()}
        found = rows.mapInArrow(_radii(self.trees), "d long, anchor boolean, node long, radius double").groupBy("d", "anchor", "node").agg(F.max("radius").alias("radius"))
        for d, side, node, radius in found.collect():  # one row a node of the trees, whose number is bounded
            self.radius[d][side][node] = radius

    def away(self, anchors: DataFrame) -> list[tuple[int, int, int]]:
        """(length, leaf of candidates, node above anchors) that the bounds leave, but for those of the same node above."""
        wants = anchors.where(self.planned).groupBy("d", "leaf").agg(F.min(F.array_min("need")).alias("need"), F.max(F.array_max("cap")).alias("cap")).collect()  # one row a leaf
        out = set()
        for d, tree in self.trees.items():
            need, cap = np.full(len(tree.centre), np.inf), np.full(len(tree.centre), -np.inf)
            for e, leaf, low, high in wants:
                if e == d:
                    need[leaf], cap[leaf] = low, high
            for i in range(len(tree.cut) - 1, -1, -1):
                need[i], cap[i] = min(need[2 * i + 1], need[2 * i + 2]), max(cap[2 * i + 1], cap[2 * i + 2])
            out |= {(d, c, _above(a)) for a, c in surviving(tree, self.radius[d], need, cap) if _above(a) != _above(c)}
        return sorted(out)

    def find(self, anchors: DataFrame, partners: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best of each anchor and slot in the candidate leaves that ``partners`` (d, leaf, over) gives to the node above it."""
        sizes = stored(anchors.groupBy("d", "over").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("groups")), "sizes")
        anchors = _spread(anchors, sizes, "d", "over").withColumn("part", F.pmod(F.xxhash64("row"), F.col("groups")))
        task = F.pmod(F.xxhash64("leaf", "salt"), F.lit(self.chunks))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = anchors.withColumn("chunk", upto(F.lit(self.chunks).cast("long")))
        right = self.blocks.join(stored(partners.join(sizes, ["d", "over"]), "partners"), ["d", "leaf"]).withColumn("chunk", task).withColumn("part", upto(F.col("groups")))
        keys = ("d", "over", "part", "chunk")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, same), _FOUND)

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """a_row, slot, score, id, row, rank: from the leaves nearby first, then from all others that can still matter.

        ``anchors``: the table of anchors with arrays need and cap, one entry a slot.
        """
        lift = F.col("leaf")
        for _ in range(LIFT):
            lift = F.when(lift > 0, F.floor((lift - 1) / 2)).otherwise(0)
        anchors = stored(anchors.withColumn("over", lift.cast("long")), "asked")
        over = {d: [(d, leaf, _above(leaf)) for leaf in range(len(t.cut), len(t.centre))] for d, t in self.trees.items()}
        home = self.spark.createDataFrame([p for found in over.values() for p in found], "d long, leaf long, over long")
        rest = anchors.where(~self.planned).select("d", "leaf", "over").distinct()  # lengths that the sample did not hold: one leaf
        near = stored(_ranked(self.find(anchors, home.unionByName(rest), k, same), k), "near")
        kth = near.where(F.col("rank") == k).groupBy(F.col("a_row").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
        raised = F.transform("need", lambda low, t: F.greatest(low, F.coalesce(F.element_at("kth", t.cast("int")), low)))
        raised = stored(anchors.join(kth, "row", "left").withColumn("need", raised).drop("kth"), "raised")
        away = self.away(raised)
        if not away:
            return near
        far = self.find(raised, self.spark.createDataFrame(away, "d long, leaf long, over long"), k, same)
        return stored(_ranked(near.drop("rank").unionByName(far), k), "best")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a_row", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For rows where ``anchor`` holds: the best ``positives`` rows of the same label, and for each the best ``negatives`` rows of
    other labels whose score is from ``low`` to ``high`` hundredths of the positive's.
    """
    rows = vectors.where("label IS NOT NULL").select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding"
    )
    rows = rows.mapInArrow(_quantised(scale), "id long, label long, anchor boolean, vec binary").where("vec IS NOT NULL")
    search = Search(stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors"), leaf)
    all_scores = [F.array(F.lit(v).cast("long")).alias(c) for v, c in ((NONE + 1, "need"), (MOST, "cap"))]
    found = search.best(search.anchors.select("*", *all_scores), positives, True).select("a_row", (F.col("rank") - 1).alias("slot"), "score", "id")
    bands = found.groupBy(F.col("a_row").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("ps"))
    bound = "transform(sequence(0, {n}), t -> coalesce(CAST({round}(CAST(ps[t] AS DECIMAL(20, 0)) * {share} / 100) AS LONG), {none}))"
    need, cap = F.expr(bound.format(n=positives - 1, round="ceil", share=low, none=f"{MOST}L")), F.expr(bound.format(n=positives - 1, round="floor", share=high, none=f"-{MOST}L"))
    asked = search.anchors.join(bands, "row").withColumn("need", need).withColumn("cap", cap).drop("ps")
    worst = search.best(asked, negatives, False).select("a_row", "slot", "rank", F.col("id").alias("n_id"), F.col("score").alias("n_score"))
    own = search.anchors.select(F.col("row").alias("a_row"), F.col("id").alias("a_id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return (
        worst.join(found, ["a_row", "slot"])
        .join(own, "a_row")
        .select(real("a_id").alias("anchor_id"), real("id").alias("positive_id"), "rank", real("n_id").alias("negative_id"), F.col("score").alias("positive_score"), F.col("n_score").alias("negative_score"))
    )
