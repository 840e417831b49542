"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of each node of the links that isn't the least itself.  Links of one task only."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _thinned(batches):
    """Of the links of each batch a forest: all to the least node that the batch reaches."""
    for batch in batches:
        node, root = forest(batch.column("u").to_numpy(), batch.column("v").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (least node reachable) of every node of the links that isn't its own root."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    e = stored(e.mapInArrow(_thinned, "u long, v long").distinct(), "links")
    seen = None
    while True:
        # large star: the larger neighbours of a node go to its least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: the smaller neighbours of a node, and it, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(old)
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = sign
