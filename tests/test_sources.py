"""Readers, writers and the streaming log."""

import gzip
import json

import numpy as np
import pytest

from corpusmetrics.operators.checks import IntegrityError
from corpusmetrics.sources import readers, schemas, writers
from corpusmetrics.streaming import logs


def sample(keyword, effort, index, **more):
    return {"keyword": keyword, "category": "c", "prompt_style": "p", "effort": effort, "sample_index": index, "idea_model": "m", "idea": f"{keyword}{index}"} | more


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_canonical_order_and_backfill(spark, tmp_path):
    a = lines(tmp_path / "a.jsonl", [sample("b", "high", 0), sample("a", "high", 1), sample("a", "none", 0, category=None)])
    b = lines(tmp_path / "b.jsonl", [sample("b", "high", 0, idea="late"), sample("a", "low", 5)])
    got = [(r["row_idx"], r["keyword"], r["effort"], r["idea"]) for r in readers.samples(spark, a, b).orderBy("row_idx").collect()]
    assert got == [(0, "a", "none", "a0"), (1, "a", "low", "a5"), (2, "a", "high", "a1"), (3, "b", "high", "b0")]


def test_malformed_lines(spark, tmp_path):
    p = lines(tmp_path / "x.jsonl", [sample("a", "low", 0), "{broken"])
    assert readers.json_lines(spark, p, schemas.SAMPLE, strict=False).count() == 1
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.json_lines(spark, p, schemas.SAMPLE).collect()


def test_gzip_and_json_sink(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.writelines(json.dumps(sample("a", "low", i)) + "\n" for i in range(5))
    df = readers.json_lines(spark, str(tmp_path / "x.jsonl.gz"), schemas.SAMPLE, partitions=2)
    writers.json_lines(df.select("keyword", "sample_index"), str(tmp_path / "out"), gzip=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_flat_judgments(spark, tmp_path):
    pair = {"keyword": "k", "effort": "low", "sample_i_index": 1, "sample_j_index": 2, "embedding_distance": 0.5, "stratum": "top", "rank": 1}
    p = lines(tmp_path / "p.jsonl", [{"request": {"pair": pair, "order": "ab", "judge_model": "j"}, "answer": "A"}])
    assert readers.pairwise(spark, p).first()["distance"] == 0.5
    q = lines(tmp_path / "q.jsonl", [{"request": {"target": {"keyword": "k", "effort": "low", "sample_row_index": 3}, "judge_model": "j"}, "scores": {"originality": 7, "feasibility": 1, "clarity": 10}}])
    assert readers.quality(spark, q).first()["originality"] == 7


def test_keyword_lists(spark, tmp_path):
    (tmp_path / "k.csv").write_text("Keyword,Category\n a ,x\n,y\nb,\n")
    assert [tuple(r) for r in readers.keyword_list(spark, str(tmp_path / "k.csv")).collect()] == [("a", "x"), ("b", None)]
    (tmp_path / "k.txt").write_text("a\n\n b\n")
    assert [r[0] for r in readers.keyword_list(spark, str(tmp_path / "k.txt")).collect()] == ["a", "b"]


def test_matrices(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    m = readers.matrix(spark, str(tmp_path / "m.npy"))
    assert [r["vec"] for r in m.orderBy("row_idx").collect()] == [[0, 1], [2, 3], [4, 5]]
    np.savez(tmp_path / "f.npz", **{"low|k|purpose": np.ones((2, 2))})
    archive = readers.facet_archive(spark, str(tmp_path / "f.npz"))
    records = spark.createDataFrame([(4, "purpose", "low", "k"), (9, "purpose", "low", "k")], "row_idx long, facet string, effort string, keyword string")
    assert readers.align_archive(records, archive).count() == 2
    with pytest.raises(IntegrityError):
        readers.align_archive(records.limit(1), archive)


def test_csv_policies(spark, tmp_path):
    empty = spark.createDataFrame([], "a long")
    assert not writers.csv(empty, str(tmp_path / "e"), when_empty="skip")
    with pytest.raises(IntegrityError):
        writers.csv(empty, str(tmp_path / "e"), when_empty="raise")
    assert writers.csv(spark.range(3), str(tmp_path / "r"), single=True)
    assert readers.table(spark, str(tmp_path / "r"), "id long").count() == 3


def test_vector_log(spark):
    log = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 2), (0, [3.0], 3)], "row_idx long, vec array<double>, line_no long")
    assert {r["row_idx"]: r["vec"] for r in writers.finalized_vectors(log, 2).collect()} == {0: [3.0], 1: [2.0]}
    with pytest.raises(IntegrityError):
        writers.finalized_vectors(log, 3)


def test_published_matrix_must_fit(spark):
    key = "row_idx long, category string, keyword string, prompt_style string, effort string, sample_index long"
    rec = spark.createDataFrame([(0, None, "k", "p", "low", 0)], key)
    vec = spark.createDataFrame([(0, [1.0])], "row_idx long, vec array<double>")
    assert readers.published_matrix(rec, rec.fillna("", ["category"]), vec).count() == 1
    with pytest.raises(IntegrityError):
        readers.published_matrix(rec, spark.createDataFrame([(0, "", "k", "p", "low", 1)], key), vec)


def test_stream_counts_replays_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"id": 1, "ts": "2024-01-01T00:00:00Z", "v": "x"}
    lines(src / "1.jsonl", [row, row, {"id": 2, "ts": "2024-01-01T00:01:00Z", "v": "y"}, "{broken"])
    schema = "id LONG, ts TIMESTAMP, v STRING"

    def go():
        logs.append(logs.once(logs.read_log(spark, str(src), schema), ["id"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)

    go()
    lines(src / "2.jsonl", [row, {"id": 3, "ts": "2024-01-01T00:02:00Z", "v": "z"}])
    go()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_judgments_with_unknown_values_raise(spark, tmp_path):
    pair = {"keyword": "k", "effort": "low", "sample_i_index": 1, "sample_j_index": 2, "embedding_distance": 0.5, "stratum": "top", "rank": 1}
    for more in ({"answer": "E"}, {"answer": None}, {"order": "aa"}):
        p = lines(tmp_path / "p.jsonl", [{"request": {"pair": pair, "order": more.get("order", "ab"), "judge_model": "j"}, "answer": more.get("answer", "A")}])
        if more == {"answer": None}:
            p = lines(tmp_path / "p.jsonl", [{"request": {"pair": pair, "order": "ab", "judge_model": "j"}}])
        with pytest.raises(IntegrityError):
            readers.pairwise(spark, p)
        assert readers.pairwise(spark, p, validate=False).count() == 1
    q = lines(tmp_path / "q.jsonl", [{"request": {"target": {"keyword": "k", "effort": "low", "sample_row_index": 3}}, "scores": {"originality": 11, "feasibility": 1, "clarity": 1}}])
    with pytest.raises(IntegrityError):
        readers.quality(spark, q)


def test_templates_need_their_placeholders(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"system": "judge", "user": "compare {a}\nand {b}"}))
    assert readers.template(spark, str(tmp_path / "t.json"), ["a", "b"])["system"] == "judge"
    with pytest.raises(IntegrityError, match="c"):
        readers.template(spark, str(tmp_path / "t.json"), ["a", "c"])


def test_grids_skip_missing_parts(spark):
    one = spark.createDataFrame([("m", 1)], "idea_model string, row_idx long")
    g = readers.panel_grid([(one, "e1", "purpose"), (None, "e1", "mechanism"), (one, "e2", "purpose")])
    assert sorted((r["embedder"], r["facet"]) for r in g.collect()) == [("e1", "purpose"), ("e2", "purpose")]
    with pytest.raises(IntegrityError, match="no part"):
        readers.panel_grid([(None, "e", "f")])
    with pytest.raises(IntegrityError, match="one model"):
        readers.panel_grid([(one.union(spark.createDataFrame([("n", 2)], one.schema)), "e", "f")])


def test_reasoning_counts_must_be_there(spark):
    s = spark.createDataFrame([("k", "low", 0), ("k", "low", 1)], "keyword string, effort string, sample_index long")
    c = spark.createDataFrame([("k", "low", 0, 7), ("k", "low", 1, 9)], "keyword string, effort string, sample_index long, reasoning_tokens long")
    assert sorted(r["reasoning_tokens"] for r in readers.with_reasoning_counts(s, c).collect()) == [7, 9]
    with pytest.raises(IntegrityError):
        readers.with_reasoning_counts(s, c.limit(1))


KEY = "row_idx long, category string, keyword string, prompt_style string, effort string, sample_index long"


def test_releases_and_matrix_order(spark, tmp_path):
    s = spark.createDataFrame([(0, "c", "a", "p", "low", 0), (1, None, "b", "p", "low", 0)], KEY)
    v = spark.createDataFrame([(0, [1.5]), (1, [2.5])], "row_idx long, vec array<double>")
    merged, vecs, keys = writers.release(s, s.where("row_idx = 0"), v)
    assert merged.count() == 2 and dict(vecs.dtypes)["vec"] == "array<float>" and {r["category"] for r in keys.collect()} == {"c", ""}
    path = lines(tmp_path / "k.jsonl", [{"category": None, "keyword": "b", "prompt_style": "p", "effort": "low", "sample_index": 0}])
    assert readers.row_keys(spark, path).first()["category"] == ""
    back = spark.createDataFrame([(5, "", "b", "p", "low", 0), (6, "c", "a", "p", "low", 0)], KEY)
    assert {(r["row_idx"], r["keyword"]) for r in writers.matrix_order(s, back).collect()} == {(5, "b"), (6, "a")}
    with pytest.raises(IntegrityError):
        writers.matrix_order(s, spark.createDataFrame([(0, "c", "z", "p", "low", 0)], KEY))
    with pytest.raises(IntegrityError):
        writers.matrix_order(s.union(s), back)


def test_cells_are_cleaned_together(spark):
    s = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "row_idx long, keyword string")
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "row_idx long, vec array<double>")
    rows, vecs, log = writers.without_keyword("a", s, v, s.select("keyword"))
    assert [r["row_idx"] for r in rows.collect()] == [1] and [r["vec"] for r in vecs.collect()] == [[2.0]] and log.count() == 1


def test_vector_logs_resume(spark, tmp_path):
    path = str(tmp_path / "v")
    writers.vectors(spark.createDataFrame([(0, [1.0], 0), (2, [2.0], 1)], "row_idx long, vec array<double>, line_no long"), path)
    assert [r["row_idx"] for r in writers.pending_rows(spark.read.parquet(path), 4).orderBy("row_idx").collect()] == [1, 3]
    writers.vectors(spark.createDataFrame([(1, [9.0], 2)], "row_idx long, vec array<double>, line_no long"), path)
    assert writers.finalized_vectors(spark.read.parquet(path), 3).count() == 3


def test_lists_matrices_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "a"), ("m1", "a"), ("m2", "b")], "generation_model string, keyword string")
    writers.keyword_filters(rows, str(tmp_path / "k"), {"m1": 1, "m2": 1})
    assert {(r["generation_model"], r["keyword"]) for r in spark.read.option("header", True).csv(str(tmp_path / "k")).collect()} == {("m1", "a"), ("m2", "b")}
    with pytest.raises(IntegrityError):
        writers.keyword_filters(rows, str(tmp_path / "x"), {"m1": 2, "m2": 1})
    long = spark.createDataFrame([("x", "x", 0.0), ("x", "y", 0.5), ("y", "x", 0.5), ("y", "y", 0.0)], "a string, b string, distance double")
    assert [tuple(r) for r in writers.square_matrix(long, ["x", "y"]).orderBy("a").collect()] == [("x", 0.0, 0.5), ("y", 0.5, 0.0)]
    with pytest.raises(IntegrityError):
        writers.square_matrix(long, ["x", "y"], most=1)
    writers.markdown(spark.createDataFrame([("b|c", 2), ("a", None)], "name string, n long"), str(tmp_path / "r"), "Report", ["name"])
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n")[:6] == ["# Report", "", "| name | n |", "| --- | --- |", "| a |  |", "| b\\|c | 2 |"]
    rec = spark.createDataFrame([(0, "k", "c", "p", "low", 0, 3, 5, "end", True, "idea")], "row_idx long, keyword string, category string, prompt_style string, effort string, sample_index long, word_count long, output_tokens long, stop_reason string, has_reasoning_block boolean, idea string")
    writers.pca_coordinates(rec, spark.createDataFrame([(0, 1.0, 2.0)], "row_idx long, x double, y double"), str(tmp_path / "c"))
    got = spark.read.option("header", True).csv(str(tmp_path / "c")).first()
    assert got["x"] == "1.0" and got["has_reasoning_block"] == "1"


def test_small_expressions(spark):
    from pyspark.sql import functions as F

    from corpusmetrics.functions import columns as C
    from corpusmetrics.functions import text as T
    from corpusmetrics.operators import judgments, lexical

    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)], "x double, y double")
    assert [r[0] for r in df.select(F.coalesce(C.finite(F.col("x"), F.col("y")), F.lit(False))).collect()] == [True, False, False, False]
    one = spark.createDataFrame([("p", None, "e")], "a string, b string, c string")
    assert one.select(T.combined(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "p e"
    cells = spark.createDataFrame([("k", 1.0, 0.01), ("k", 3.0, 0.2), ("k", float("nan"), float("nan"))], "k string, v double, p double")
    r = lexical.cell_aggregate(cells, ["k"], "v", "p").first()
    assert (r["n"], r["mean"], r["median"], r["n_significant"]) == (2, 2.0, 2.0, 1) and r["q90"] == pytest.approx(2.8)
    vecs = spark.createDataFrame([(0, "f", [1.0, 0.0]), (1, "f", [0.0, 2.0]), (0, "g", [1.0, 0.0]), (1, "g", [3.0, 0.0])], "row_idx long, facet string, vec array<double>")
    pairs = spark.createDataFrame([(0, 1, "A")], "i long, j long, answer string")
    assert {r["facet"]: r["facet_distance"] for r in judgments.facet_distances(pairs, vecs).collect()} == {"f": 1.0, "g": 0.0}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines(src / "1.jsonl", [{"id": k % 2, "ts": f"2024-01-01T00:0{k}:00Z"} for k in range(6)] + [{"id": 9, "ts": "2024-01-01T09:00:00Z"}])
    counts = logs.windowed_counts(logs.read_log(spark, str(src), "id LONG, ts TIMESTAMP"), "ts", "5 minutes", ["id"])
    logs.append(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["window"]["start"].minute, r["id"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 0): 3, (0, 1): 2, (5, 1): 1}
