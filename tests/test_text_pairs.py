"""Distances of texts over all pairs of a group: counted by tiles of compressed bigram sets."""

import itertools
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmetrics.functions import bigrams
from corpusmetrics.operators import lexical as L
from corpusmetrics.operators import pairs as P


def jaccard(a, b):
    a, b = ({s[i : i + 2] for i in range(len(s) - 1)} if len(s) > 1 else {s} - {""} for s in (a or "", b or ""))
    return 1 - len(a & b) / len(a | b) if a | b else 0.0


ODD = [None, "", "a", "\x00a", "aa", "ab", "ab", "a\U0001f600b", "\U0001f600", "Ünïcode", "x" * 50, "abcabc"]


def made(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 30)))) for _ in range(n)]


@pytest.mark.parametrize("least", [16384, 5])
def test_summary_equals_a_plain_loop(spark, monkeypatch, least):
    monkeypatch.setattr(L, "SET_TILE", least)
    groups = {"odd": ODD, "many": made(90, 1), "two": ["ab", "bc"], "one": ["ab"], "empty": [None, "", ""]}
    rows = [(g, i, t) for g, texts in groups.items() for i, t in enumerate(texts)] + [(None, 0, "ab"), (None, 1, "bc")]
    df = spark.createDataFrame(rows, "g string, row_idx long, t string").repartition(7)
    got = {r["g"]: tuple(r)[1:] for r in L.string_distance_summary(df, ["g"], "t").collect()}
    assert got.keys() == {"odd", "many", "two", "empty"}
    for g in got:
        d = [jaccard(a, b) for a, b in itertools.combinations(groups[g], 2)]
        assert got[g] == pytest.approx((len(d), statistics.mean(d), statistics.median(d), statistics.pstdev(d)), abs=1e-12), g


def test_texts_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Forty least tiles: a set goes to sixteen tasks, not to forty."""
    monkeypatch.setattr(L, "SET_TILE", 5)
    df = spark.createDataFrame([("g", t) for t in made(200, 2)], "g string, t string").repartition(25)
    packed = L.packed_sets(df, ["g"], "t", L.SET_TILE)
    once, sent = packed.count(), P.meeting(packed).count()
    assert packed.select("__tiles").distinct().collect()[0][0] == P.TILES and sent == P.TILES * once
    sizes = [r["n"] for r in spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select(P.tiles(F.lit(P.MOST) * F.lit(16) * F.col("k"), 5).alias("n")).collect()]
    assert sizes == [16, 32, 48, 64, 80]  # a tile has at most MOST rows


@pytest.mark.parametrize("common", [0, 1000, 1 << 40])
def test_common_and_rare_bigrams_count_alike(monkeypatch, common):
    monkeypatch.setattr(bigrams, "COMMON", common)
    monkeypatch.setattr(bigrams, "ROWS", 16)
    texts = ODD + made(150, 3)
    sets = [bigrams.codes(t) for t in texts]
    first, second = (bigrams.Tile([bigrams.to_blob(s[:30]), bigrams.to_blob(s[30:])], False) for s in (sets[:70], sets[70:]))
    for a, b, ia, ib in ((first, second, sets[:70], sets[70:]), (first, first, sets[:70], sets[:70])):
        seen = 0
        for x, y, both in bigrams.overlaps(a, b):
            want = [[len(set(p.tolist()) & set(q.tolist())) for q in ib[y]] for p in ia[x]]
            assert both.tolist() == want
            seen += both.size
        assert seen == len(ia) * len(ib) or a is b
