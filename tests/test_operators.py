"""Operators on small tables with the awkward cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmetrics.functions import columns as C
from corpusmetrics.functions import kernels as K
from corpusmetrics.functions import text as T
from corpusmetrics.operators import checks, diversity, judgments, lexical, quality, selection, statistics, tasks, tokens
from corpusmetrics.operators import neighbours as N


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i < 7 else "b" if i < 9 else "c", "low", f"g{i % 2}", rng.normal(size=4).tolist()) for i in range(10)]
    rows[2] = (2, "a", "low", "g0", [0.0] * 4)  # zero vector
    rows[4] = (4, "a", "low", "g0", rows[3][4])  # exact copy
    return spark.createDataFrame(rows, "row_idx long, keyword string, effort string, gen string, vec array<double>")


def test_closed_form_is_the_mean_of_pairs(vectors):
    closed = {r["keyword"]: r for r in diversity.mean_pairwise_distance(vectors).collect()}
    pairs = {r["keyword"]: r for r in diversity.pair_summary(vectors, ["keyword"]).collect()}
    assert closed["c"]["mean_distance"] == 0.0 and closed["c"]["n"] == 1
    assert closed["a"]["mean_distance"] == pytest.approx(pairs["a"]["mean_distance"], abs=1e-12)
    assert pairs["a"]["n_pairs"] == 21 and pairs["b"]["n_pairs"] == 1 and "c" not in pairs


def test_separability_against_plain_loops(vectors):
    got = diversity.separability(vectors).first()
    rows = vectors.collect()
    u = {r["row_idx"]: np.array(r["vec"]) / (np.linalg.norm(r["vec"]) or 1) for r in rows}
    k = {r["row_idx"]: r["keyword"] for r in rows}
    d = lambda i, j: 1 - u[i] @ u[j]
    intra = np.mean([d(i, j) for i in u for j in u if i != j and k[i] == k[j]])
    inter = np.mean([d(i, j) for i in u for j in u if k[i] != k[j]])
    assert got["intra"] == pytest.approx(intra) and got["inter"] == pytest.approx(inter)
    assert got["separability"] == pytest.approx(inter / intra)


def test_neighbours_exclude_self_by_id(vectors):
    near = {r["i"]: r["j"] for r in N.neighbours(vectors, ["effort"], "gen", 1).collect()}
    assert near[3] == 4 and near[4] == 3
    assert N.panel_purity(N.neighbours(vectors.where("row_idx < 2"), ["effort"], "gen", 5), ["effort"]).count() == 0


def test_middle_needs_enough_pairs(vectors):
    assert {r["keyword"] for r in selection.too_few_pairs(vectors, ["keyword"], 5).collect()} == {"b", "c"}
    s = selection.stratified_pairs(vectors, ["keyword"], 3, short="all").where("keyword = 'a'").groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in s} == {"top": 3, "middle": 3, "bottom": 3}
    with pytest.raises(Exception, match="fewer than 3 pairs in b"):
        selection.stratified_pairs(vectors, ["keyword"], 3).collect()


@pytest.fixture(scope="module")
def lined(spark):
    """Unit vectors at 0, 10, 30, 60 and 100 degrees: all ten distances differ."""
    import math

    rows = [(i, "k", "low", f"g{i % 2}", [math.cos(math.radians(a)), math.sin(math.radians(a))]) for i, a in enumerate((0, 10, 30, 60, 100))]
    return spark.createDataFrame(rows, "row_idx long, keyword string, effort string, gen string, vec array<double>")


def test_middle_pairs_run_from_near_to_far(lined):
    """Angles of the ten pairs in order: 10 20 30 30 40 50 60 70 90 100, by (i, j) among equals."""
    got = {(r["stratum"], r["rank"]): (r["i"], r["j"]) for r in selection.stratified_pairs(lined, ["keyword"], 2, 4).collect()}
    assert got["top", 1] == (0, 4) and got["top", 2] == (1, 4) and got["bottom", 1] == (0, 1) and got["bottom", 2] == (1, 2)
    assert [got["middle", k] for k in (1, 2, 3, 4)] == [(2, 3), (3, 4), (1, 3), (0, 3)]


@pytest.mark.parametrize("tile", [1024, 2])
def test_tiles_give_the_distances_of_plain_loops(vectors, monkeypatch, tile):
    from corpusmetrics.operators import pairs as P

    monkeypatch.setattr(P, "TILE", tile)
    rows = [r for r in vectors.collect() if r["keyword"] == "a"]
    u = {r["row_idx"]: np.array(r["vec"]) / (np.linalg.norm(r["vec"]) or 1) for r in rows}
    want = {(i, j): 1 - u[i] @ u[j] for i in u for j in u if i < j}
    got = {(r["i"], r["j"]): r["distance"] for r in diversity.pair_distances(vectors, ["keyword"]).where("keyword = 'a'").collect()}
    assert got == pytest.approx(want, abs=1e-11)
    s = diversity.pair_summary(vectors, ["keyword"]).where("keyword = 'a'").first()
    assert s["median_distance"] == pytest.approx(np.median(list(want.values())), abs=1e-11) and s["std_distance"] == pytest.approx(np.std(list(want.values())), abs=1e-9)
    whole = diversity.pair_summary(vectors, ["keyword", "effort"], ["effort"]).first()
    both = [*want.values(), *(r["distance"] for r in diversity.pair_distances(vectors, ["keyword"]).where("keyword = 'b'").collect())]
    assert whole["n_pairs"] == 22 and whole["median_distance"] == pytest.approx(np.median(both), abs=1e-11)
    near = {(r["i"], r["rank"]): r["j"] for r in N.neighbours(vectors, ["keyword"], "gen", 2).where("keyword = 'a'").collect()}
    for i in u:
        order = sorted((j for j in u if j != i), key=lambda j: (round(1 - u[i] @ u[j], 12), f"g{j % 2}", j))
        assert [near[i, 1], near[i, 2]] == order[:2]


def test_silhouette_and_label_distances_against_plain_loops(vectors):
    rows = vectors.collect()
    u = {r["row_idx"]: np.array(r["vec"]) / (np.linalg.norm(r["vec"]) or 1) for r in rows}
    g = {r["row_idx"]: r["gen"] for r in rows}
    d = lambda i, j: 1 - u[i] @ u[j]
    s = []
    for i in u:
        a = np.mean([d(i, j) for j in u if j != i and g[j] == g[i]])
        b = np.mean([d(i, j) for j in u if g[j] != g[i]])
        s.append((b - a) / max(a, b))
    assert N.silhouette(vectors, ["effort"], "gen").first()["silhouette"] == pytest.approx(np.mean(s))
    for r in N.label_distances(vectors, ["effort"], "gen").collect():
        own = [i for i in u if g[i] == r["label"]]
        within, between = np.mean([d(i, j) for i in own for j in own if i < j]), np.mean([d(i, j) for i in own for j in u if g[j] != r["label"]])
        assert (r["within"], r["between"], r["ratio"]) == pytest.approx((within, between, within / between))


def test_leave_one_out_takes_the_mean_of_keyword_means(vectors):
    """a has 21 pairs, b one, c none: the mean of the means of a and b, however many pairs they have."""
    rows = vectors.collect()
    u = {r["row_idx"]: np.array(r["vec"]) / (np.linalg.norm(r["vec"]) or 1) for r in rows}
    k = {r["row_idx"]: r["keyword"] for r in rows}
    mean = lambda keys: np.mean([np.mean([1 - u[i] @ u[j] for i in u for j in u if i < j and k[i] == k[j] == x]) for x in keys])
    inter = lambda keys: np.mean([1 - u[i] @ u[j] for i in u for j in u if k[i] != k[j] and k[i] in keys and k[j] in keys])
    got = {r["keyword"]: r for r in diversity.leave_one_out(vectors).collect()}
    assert got["c"]["separability"] == pytest.approx(inter("ab") / mean("ab"))
    assert got["a"]["separability"] == pytest.approx(inter("bc") / mean("b"))
    assert got["c"]["shift"] == pytest.approx(inter("ab") / mean("ab") - inter("abc") / mean("ab"))


def test_centroids_of_cells_are_of_raw_vectors(spark):
    df = spark.createDataFrame([(0, "k", "x", [4.0, 0.0]), (1, "k", "x", [0.0, 2.0]), (2, "k", "y", [1.0, 0.0]), (3, "k", "y", [3.0, 0.0])], "row_idx long, keyword string, gen string, vec array<double>")
    r = diversity.cross_within(df, "keyword", "gen").first()
    # centroids (2, 1) and (2, 0); unit vectors would give (1, 1) and (2, 0)
    assert r["centroid_distance"] == pytest.approx(1 - 2 / 5**0.5)


def test_calibration_is_by_tier(spark):
    df = spark.createDataFrame([("low", "A", 0.01), ("high", "B", 0.02), ("high", "A", 0.03)], "effort string, answer string, distance double")
    assert {(r["effort"], r["n"]) for r in judgments.calibration(df).collect()} == {("low", 1), ("high", 2)}


def test_white_space_of_any_kind(spark):
    import hashlib

    df = spark.createDataFrame([("\n idea\t",), ("\n\t",), ("\u00a0\u3000",), ("\x1c a b \u2003",), (None,)], "t string")
    r = df.select(C.is_blank(F.col("t")).alias("b"), C.text_key(F.col("t")).alias("k")).collect()
    assert [x["b"] for x in r] == [False, True, True, False, True]
    assert r[0]["k"] == hashlib.sha1(b"idea").hexdigest()[:16] and r[3]["k"] == hashlib.sha1(b"a b").hexdigest()[:16]


def test_reasoning_tokens_of_texts_without_a_block_are_zero(spark):
    df = spark.createDataFrame([(True, 10, 30, 5), (False, 40, 30, 5), (True, 40, 30, 5)], "b boolean, o long, v long, h long")
    got = [r[0] for r in df.select(C.reasoning_by_subtraction(F.col("b"), F.col("o"), F.col("v"), F.col("h"))).collect()]
    assert got == [-15, 0, 15]


def test_terms_are_weighted_by_the_size_of_their_keyword(spark):
    """x: a a b, y: b, z: no tokens.  idf of a is ln 3, of b ln 1.5."""
    rows = [("c", "x", "a", 2), ("c", "x", "b", 1), ("c", "y", "b", 1)]
    v = spark.createDataFrame(rows, "category string, keyword string, token string, tf long")
    keys = spark.createDataFrame([("c", k) for k in "xyz"], "category string, keyword string")
    s = lexical.tf_idf(v, ["category"], "keyword", keys)
    got = {(r["keyword"], r["token"]): r["tf_idf"] for r in s.collect()}
    assert got == pytest.approx({("x", "a"): 2 / 3 * np.log(3), ("x", "b"): np.log(1.5) / 3, ("y", "b"): np.log(1.5)})
    assert lexical.idf_mean(s, ["category"]).first()["mean_idf"] == pytest.approx((2 * np.log(3) + 2 * np.log(1.5)) / 4)
    j = lexical.vocabulary_jaccard(v, ["category"], "keyword", keys).first()
    assert j["n_keys"] == 3 and j["mean_jaccard"] == pytest.approx((1 / 2 + 0 + 0) / 3)
    more = keys.union(spark.createDataFrame([("c", "w")], "category string, keyword string"))
    assert lexical.vocabulary_jaccard(v, ["category"], "keyword", more).first()["mean_jaccard"] == pytest.approx(0.5 / 5)
    assert [r["token"] for r in lexical.universal_words(v, "keyword", keys, 0.7).collect()] == ["b"]


def test_the_lowest_tier_present_is_the_base(spark):
    df = spark.createDataFrame([("k", "low", 1.0), ("k", "high", 4.0)], "keyword string, effort string, x double")
    assert quality.per_keyword_wide(df, ["keyword"], ["x"], ["none", "low", "medium", "high"]).collect()[0].asDict() == {"keyword": "k", "x_low": 1.0, "x_high": 4.0, "x_delta": 3.0}


def test_short_samples_fail(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "g string, i long")
    with pytest.raises(Exception, match="fewer than 3 rows in b"):
        selection.seeded_sample(df, ["g"], ["i"], 3).collect()
    assert selection.seeded_sample(df, ["g"], ["i"], 3, short="all").count() == 4


def test_prefix_must_hit_one_row(spark):
    from corpusmetrics.operators import contrasts

    df = spark.createDataFrame([("vs-low (a)", 1), ("vs-high", 2), ("vs-high", 3)], "label string, x long")
    assert contrasts.one_by_prefix(df, "label", "vs-low").first()["x"] == 1
    for prefix in ("vs-high", "none"):
        with pytest.raises(Exception, match="not one row"):
            contrasts.one_by_prefix(df, "label", prefix).collect()
    assert spark.sql("SELECT array('b', 'a', 'b') AS v").select(C.distinct_in_order(F.col("v"))).first()[0] == ["b", "a"]


def test_gain_table_by_hand(spark):
    from corpusmetrics.operators import contrasts

    cells = [(k, "vs", "low", v) for k, v in zip("abcd", (3.0, 4.0, 5.0, 6.0), strict=True)] + [(k, "default", "low", v) for k, v in zip("abcd", (1.0, 2.0, 4.0, 3.0), strict=True)]
    c = spark.createDataFrame(cells, "keyword string, kind string, effort string, value double")
    strata = contrasts.baseline_strata(c, ["value"])
    assert {r["keyword"]: r["stratum"] for r in strata.collect()} == {"a": "Q1", "b": "Q1", "c": "Q4", "d": "Q4"}
    rows = contrasts.gains(c, strata, [("vs", "low", "default", "low"), ("vs", "high", "default", "low")])
    m = contrasts.gain_means(rows).collect()
    assert len(m) == 1 and m[0].asDict() == pytest.approx({"contrast": "vs-low vs default-low", "n_q1": 2, "abs_gain_q1": 2.0, "rel_gain_q1": 1.5, "n_q4": 2, "abs_gain_q4": 2.0, "rel_gain_q4": 0.625, "abs_gain_ratio": 1.0, "rel_gain_ratio": 2.4})
    t = contrasts.gain_tests(rows, n_boot=500).first()
    assert t["wilcoxon_q1_p"] is None and t["mannwhitney_p"] is not None and t["abs_gain_q1_ci_low"] <= 2.0 <= t["abs_gain_q1_ci_high"]
    v = spark.createDataFrame([(k, e, x) for k, e, x in [("a", "none", 0.0), ("a", "low", 0.5), ("b", "none", 0.5), ("b", "low", 0.5), ("c", "low", 1.0)]], "keyword string, effort string, value double")
    e = contrasts.paired_effects(v, [("none", "low"), ("low", "high")]).collect()
    assert len(e) == 1 and (e[0]["n_keywords"], e[0]["mean_baseline"], e[0]["mean_diff"]) == (2, 0.25, 0.25) and e[0]["cohens_dz"] == pytest.approx(0.25 / np.std([0.5, 0], ddof=1))


def test_bin_edges_are_half_open(spark):
    df = spark.createDataFrame([("A", 0.0), ("B", 0.05), ("C", 0.699), ("D", 0.7)], "answer string, distance double")
    bins = {(r["lo"], r["hi"]): r["n"] for r in judgments.calibration(df, []).collect()}
    assert bins == {(0.0, 0.05): 1, (0.05, 0.1): 1, (0.55, 0.7): 1}
    assert judgments.beyond_bins(df).first()[0] == 1


def test_kappa_without_a_middle_label(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "D"), ("D", "D"), ("D", "D")], "a string, b string")
    r = judgments.kappa(df, [], "a", "b").first()
    assert r["agreement"] == 0.75 and r["kappa"] == pytest.approx(0.5) and r["weighted_kappa"] == pytest.approx(0.5)
    one = judgments.kappa(df.where("a = 'D'"), [], "a", "b").first()
    assert one["kappa"] is None and one["weighted_kappa"] is None


def test_self_bleu_against_kernel(spark):
    texts = ["the cat sat on the mat", "the cat sat", "", "a dog sat on the mat today", "the the the"]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "row_idx long, keyword string, text string")
    got = {r["n"]: r["self_bleu"] for r in lexical.self_bleu(df, ["keyword"], 3).collect()}
    toks = [t.split() for t in texts]
    for n in (1, 2, 3):
        assert got[n] == pytest.approx(np.mean([K.bleu(t, toks[:i] + toks[i + 1 :], n) for i, t in enumerate(toks)]))


def test_distinct_n_of_short_texts(spark):
    df = spark.createDataFrame([(0, "k", "a"), (1, "k", "")], "row_idx long, keyword string, text string")
    assert {r["n"]: (r["distinct_n"], r["total"]) for r in lexical.distinct_n(df, ["keyword"], 2).collect()} == {1: (1.0, 1), 2: (0.0, 0)}


def test_text_functions(spark):
    r = spark.createDataFrame([("",), ("a",), ("aab\x00  b c ",)], "t string").select(T.char_entropy(F.col("t")).alias("e"), T.bigram_set(F.col("t")).alias("b"), T.clean(F.col("t")).alias("c"), T.word_count(F.col("t")).alias("w")).collect()
    assert r[0]["e"] == 0 and r[0]["b"] == [] and r[0]["w"] == 0
    assert r[1]["b"] == ["a"] and r[1]["e"] == 0
    assert r[2]["c"] == "aab b c" and r[2]["w"] == 3


def test_column_functions(spark):
    df = spark.createDataFrame([("EffortName.LOW", 0.0, "Max_Tokens", "AB c_d-é!"), ("zzz", 2.0, None, "!!")], "e string, x double, s string, t string")
    r = df.select(C.effort_name(F.col("e")).alias("e"), C.effort_order(F.col("e")).alias("o"), C.safe_ratio(F.lit(1), F.col("x")).alias("q"), C.stopped_at_limit(F.col("s")).alias("s"), C.hyphen_slug(F.col("t")).alias("h"), C.underscore_slug(F.col("t")).alias("u"), C.filled("<{a}{b}>", {"a": F.lit("{b}"), "b": F.lit("x")}).alias("f")).collect()
    assert tuple(r[0]) == ("low", 99, None, True, "ab-c-d-é", "ab_c_d", "<xx>")
    assert r[1]["q"] == 0.5 and r[1]["s"] is False and r[1]["h"] == "keyword" and r[1]["u"] == "judge"


def test_guarded_corr(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in df.groupBy("g").agg(C.guarded_corr("x", "y").alias("r")).collect()}
    assert got["a"] is None and got["c"] is None and got["b"] == pytest.approx(1)


def test_calls_count_once(spark):
    rows = [("k", "low", i, 5, 7, 20, 3) for i in range(6)]
    df = spark.createDataFrame(rows, "keyword string, effort string, sample_index long, input_tokens long, output_tokens long, total_tokens long, reasoning_tokens long")
    t = tokens.call_totals(tokens.calls(df, ["keyword", "effort"], 3), ["keyword", "effort"]).first()
    assert (t["n_calls"], t["total_tokens"], t["visible_tokens"]) == (2, 40, 24)


def test_join_keeps_repeated_texts(spark):
    s = spark.createDataFrame([("t", "s", 1.0), ("t", "s", 2.0)], "key string, judge string, score double")
    r = quality.calibration_r(s, s, ["key"], [], least_rows=1).first()
    assert r["n"] == 4


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = {r["p"]: r["p_adjusted"] for r in statistics.benjamini_hochberg(df, "p").collect()}
    assert got[0.01] == pytest.approx(0.03) and got[0.03] == pytest.approx(0.04) and got[0.04] == pytest.approx(0.04) and got[None] is None


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id long, w string")
    assert checks.duplicate_keys(a, ["id"]).collect()[0]["n"] == 2
    with pytest.raises(checks.IntegrityError):
        checks.one_to_one(a, b, ["id"])
    assert checks.unique(b, ["id"]).count() == 2
    with pytest.raises(Exception, match="not unique: 1"):
        checks.unique(a, ["id"]).collect()
    assert {(r["id"], r["only_in"]) for r in checks.key_set_diff(a, b, ["id"]).collect()} == {(1, "left"), (3, "right")}
    assert checks.uneven_groups(a, ["id"]).count() == 1
    assert checks.out_of_range(spark.createDataFrame([(2.1,), (1.0,), (float("nan"),)], "d double"), "d", 0, 2).count() == 2
    m = spark.createDataFrame([("p", 1)], "a string, b long")
    assert [r["field"] for r in checks.incompatible(m, spark.createDataFrame([("p", 2)], "a string, b long"), ["a", "b"]).collect()] == ["b"]


def test_tasks(spark):
    kw = spark.createDataFrame([("x",), ("y",)], "keyword string")
    space = tasks.task_space(kw, ["low", "high"], 3)
    assert space.count() == 12
    done = space.where("keyword = 'x' and effort = 'low'")
    key = ["keyword", "effort", "sample_index"]
    todo = tasks.missing_tasks(space, done, key)
    assert todo.count() == 9
    out = tasks.run_tasks(todo, tasks.echo_client("keyword"), "keyword string, effort string, sample_index long, response string, error_message string", 2)
    ok, bad = tasks.split_by_status(out)
    assert ok.count() == 9 and bad.count() == 0
    calls = spark.createDataFrame([(2, ["a", "b", "c"])], "batch_index long, responses array<string>")
    assert [r["sample_index"] for r in tasks.explode_calls(calls).orderBy("sample_index").collect()] == [6, 7, 8]


def test_windows_travel_once(spark):
    """Shared by buckets that differ in one column, at a few bytes for the grams of all orders; the results are those of buckets dealt apart."""
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], " ".join(f"w{w}" for w in rng.zipf(1.3, 60) % 500)) for i in range(200)] + [(900, "a", None), (901, "b", "w1")]
    df = spark.createDataFrame([(i, k, f, t if f == "all" or t is None else t[: len(t) // 2]) for i, k, t in rows for f in ("all", "half")], "row_idx long, k string, facet string, text string").repartition(2)
    tokens = df.where("text is not null").selectExpr("sum(size(split(text, ' '))) n").first()["n"]
    for index in (None, "row_idx"):
        dealt = lexical._dealt(df, ["k", "facet"], 6, 1, "facet", index)
        assert dealt.selectExpr("sum(length(blob)) b").first()["b"] < 24 * tokens
    for name in ("distinct_n", "self_bleu"):
        got = [sorted(getattr(lexical, name)(df, ["k", "facet"], 6, nested=nested).collect(), key=str) for nested in ("facet", None)]
        assert len(got[0]) == 24 and [r[:3] for r in got[0]] == [r[:3] for r in got[1]]
        assert [r[3:] for r in got[0]] == [pytest.approx(r[3:]) for r in got[1]]


def test_texts_are_tokenised_once(spark, tmp_path):
    """One scan finds the tokens, and Spark sets no filter before it that would find them again."""
    df = spark.createDataFrame([("c", "a", "one two two"), ("c", "b", "two three"), ("c", None, "three"), (None, "a", "two"), ("c", "d", None)], "category string, keyword string, t string")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    vocab = lexical.vocabulary(df, ["category", "keyword"], T.vocabulary_tokens(F.col("t")))
    keys = df.select("category", "keyword")
    by_token, by_key = lexical.token_idf(vocab, ["category"], "keyword", keys), lexical.tf_idf(vocab, ["category"], "keyword", keys)
    assert {tuple(r) for r in by_token.select("token", "tf", "df", "N").collect()} == {("one", 1, 1, 4), ("two", 3, 2, 4), ("three", 1, 2, 4)}
    assert {tuple(r) for r in by_key.select("keyword", "token", "tf", "df").collect()} == {("a", "one", 1, 1), ("a", "two", 2, 2), ("b", "two", 1, 2), ("b", "three", 1, 2)}
    means = [lexical.idf_mean(d, ["category"]).first()["mean_idf"] for d in (by_token, by_key)]
    assert means[0] == pytest.approx(means[1])
    for d in (by_token, by_key):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_entropy_by_characters(spark):
    r = spark.createDataFrame([(None,), ("",), ("👍👍ab",), ("\x00\x00",)], "t string").select(T.char_entropy(F.col("t")).alias("e")).collect()
    assert [x["e"] for x in r] == pytest.approx([0, 0, 1.5, 0])
    assert "sort_array" not in spark.range(1).select(T.char_entropy(F.col("id").cast("string")))._jdf.queryExecution().toString()
