"""Hard negatives against all pairs."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmetrics.llm import hard_negatives as hn
from corpusmetrics.llm.queries import OP12_SQL, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row long, d long, leaf long, need string"


def got(rows, every=10, **more):
    return sorted((tuple(r) for r in hn.hard_negatives(rows, F.col("vec_id") % every == 0, **more).collect()), key=repr)


def want(rows, every=10, **more):
    return sorted(brute.hard_negatives([tuple(r) for r in rows.select("vec_id", "embedding", "label").collect()], lambda i: i % every == 0, **more), key=repr)


def table(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, 1, 1, "x") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clustered():
    """Forty tight clusters, labels mixed within them; one vector stands in a third of the rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.02 * rng.normal(size=8)).tolist(), int(rng.integers(4))) for i in range(800)]
    return rows + [(1000 + i, centres[0].tolist(), i % 3) for i in range(400)]


@pytest.mark.parametrize("leaf", [16, 100, 4096])
def test_equal_to_all_pairs(spark, clustered, leaf):
    rows = table(spark, clustered)
    assert got(rows, leaf=leaf) == want(rows)


def test_bounds_hold_and_discard_node_pairs(clustered):
    """Every product lies within the interval of its nodes; of clustered rows most pairs of leaves go."""
    x = np.floor(256 * np.array([v for _, v, _ in clustered[:800]]))
    tree = hn.Tree(x[:320], 32)
    nodes = tree.nodes(x)
    far = np.full(len(tree.centre), -1.0)
    for k in range(nodes.shape[1]):
        np.maximum.at(far, nodes[:, k], np.sqrt(((x - tree.centre[nodes[:, k]]) ** 2).sum(axis=1)))
    s = x @ x.T
    leaf = nodes[:, -1]
    for a in np.unique(leaf):
        for c in np.unique(leaf):
            low, high = hn.interval(tree.centre[a], far[a], tree.centre[c], far[c])
            part = s[np.ix_(leaf == a, leaf == c)]
            assert low <= part.min() and part.max() <= high
    tenth = np.sort(s, axis=1)[:, -10]
    need, cap = np.full(len(far), np.inf), np.full(len(far), np.inf)
    np.minimum.at(need, nodes.ravel(), np.repeat(tenth, nodes.shape[1]))
    pairs = hn.surviving(tree, {True: far, False: far}, need, cap)
    assert {(leaf[i], leaf[j]) for i, j in zip(*np.nonzero(s >= tenth[:, None]), strict=True)} <= set(pairs)
    assert len(pairs) < 0.2 * len(np.unique(leaf)) ** 2


def test_unclustered_rows_and_other_settings(spark):
    rng = np.random.default_rng(6)
    rows = table(spark, [(i, rng.normal(size=5).tolist(), int(rng.integers(3))) for i in range(300)])
    more = {"scale": 10, "positives": 2, "negatives": 4, "low": 10, "high": 60}
    assert got(rows, leaf=20, **more) == want(rows, **more)


def test_ties_go_by_id(spark):
    """Many equal scores; all but a few vectors are equal."""
    rows = table(spark, [(i, [1.0, 0.5] if i % 50 else [2.0, 1.0], i % 2) for i in range(500)])
    assert got(rows, leaf=30) == want(rows)
    rows = table(spark, [(i, [1.0, float(i % 3)], i % 5) for i in range(200)])
    assert got(rows, leaf=30) == want(rows) != []


def test_odd_rows(spark):
    """Nulls, non-finite values, lengths, empty and zero vectors, repeated rows, null ids, scores beyond 53 and 64 bits, no rows."""
    big = [(100 + i, [3e7 + i, 2e7 - i, float(i)], i % 2) for i in range(30)]
    huge = [(200 + i, [1e18, 1e300, -1.0 * i], i % 2) for i in range(20)]
    odd = [(0, None, 1), (10, [1.0, None], 1), (20, [1.0, float("nan")], 1), (30, [float("inf"), 1.0], 0), (40, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (None, [1.0, 2.0], 0)]
    odd += [(50, [1.0, 2.0], 1)] * 3 + [(51, [1.0, 1.0], 0), (52, [0.5, 1.0], 0), (60, [], 1), (61, [], 1), (62, [], 0), (70, [0.0, 0.0], 1), (80, [1.0] * 3000, 1), (81, [1.1] * 3000, 1), (82, [0.5] * 3000, 0), (90, [-1.0, 0.0], 1), (91, [1.0, 0.0], 1)]
    rows = table(spark, odd + big + [(i, [float(j) for j in v], y) for i, v, y in huge])
    assert got(rows) == want(rows)
    assert got(rows, leaf=8) == want(rows)
    assert got(rows.limit(0)) == []
    assert got(rows, every=7777) == want(rows, every=7777)


def test_query_and_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    rows = op12_hard_negatives(spark, sf)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
        said = con.sql(OP12_SQL)
        assert said.columns == rows.columns
        assert sorted(said.fetchall()) == sorted(tuple(r) for r in rows.collect())
