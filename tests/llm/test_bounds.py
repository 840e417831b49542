"""Bounds that hold without leaving rows out, and priors that one label does not overturn."""

import brute
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmetrics.llm import sketch
from corpusmetrics.llm import toxicity as tox
from corpusmetrics.llm.jaccard_join import jaccard_join
from corpusmetrics.llm.url_filter import url_filter


def test_one_bad_label_blocks_only_its_host(spark):
    """Neither another host of the domain, nor of the suffix, nor a null url; one good label allows all."""
    pages = spark.createDataFrame([(1, "http://a.x.com/p"), (2, "http://a.x.com/q"), (3, "http://b.x.com/p"), (4, "http://y.com/p"), (5, "http://z.de/p"), (6, None)], "page_id long, url string")
    for bad, want in ((1, {"a.x.com"}), (0, set())):
        outcomes = spark.createDataFrame([(1, bad)], "page_id long, bad int")
        got = url_filter(pages, outcomes).collect()
        assert {r["host"] for r in got if r["verdict"] == "block"} == want
        assert len(got) == 6


def test_labels_of_one_kind_and_long_urls(spark):
    """Many bad labels of many hosts condemn the unknown; many good ones do not.  An url of a million characters has its host judged."""
    long = "http://h1.com/" + "x" * 1_000_000
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.com/{i}") for i in range(200)] + [(900, long), (901, "http://new.org/p")], "page_id long, url string")
    for bad, verdict in ((1, "block"), (0, "allow")):
        outcomes = spark.range(200).select(F.col("id").alias("page_id"), F.lit(bad).alias("bad"))
        got = {r["page_id"]: r["verdict"] for r in url_filter(pages, outcomes).collect()}
        assert set(got.values()) == {verdict} and len(got) == 202


def test_the_training_task_gets_one_row_an_id_and_no_text_is_left_out(spark, monkeypatch):
    """3,000 rows of one id reach it as one; a text of a million characters as a stretch of it."""

    def instead(totals, most):
        def run(batches):
            rows = pa.Table.from_batches(list(batches)).to_pandas().sort_values("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array([repr([(i, len(t)) for i, t in zip(rows["doc_id"], rows["text"], strict=True)]).encode()], pa.binary())], names=["model"])

        return run

    monkeypatch.setattr(tox, "_trained", instead)
    long = "".join(chr(97 + k % 26) for k in range(1_000_000))
    rows = [(7, f"text {i}") for i in range(3000)] + [(8, long), (9, None), (10, "ä" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = spark.createDataFrame([(i, i % 2) for i in (7, 8, 9, 10)], "doc_id long, __y int")
    seen = eval(tox.fitted(docs, known, tox.sample_ids(known, 100), 100))  # noqa: S307
    assert seen == [(7, len("text 999")), (8, tox.TRAIN_CHARS), (9, 0), (10, tox.TRAIN_CHARS)]


def test_stretches_are_not_prefixes(spark):
    """Where the stretch begins follows from the id: toxic words at the end of long texts are learnt."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        text = " ".join(rng.choice(words, 4000))
        rows.append((i, text[:6000] + " " + " ".join(rng.choice(words[:150] + ["vile"] * 20 * toxic, 4000)), "en"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tox.toxicity(docs, lab, F.col("doc_id") % 4 != 2).where("doc_id % 4 = 2 OR doc_id % 4 = 3").join(lab, "doc_id").collect()
    high = np.mean([r["score"] for r in got if r["toxic"] == 1])
    low = np.mean([r["score"] for r in got if r["toxic"] == 0])
    assert high > low + 0.3


def test_slices_keep_a_sketch_sparse(spark, monkeypatch):
    """Six times as many keys as a broadcast has counters: single keys still look single, repeated ones never do."""
    monkeypatch.setattr(sketch, "MOST_BITS", 20)
    n, each = 30, 200_000

    def keys_of(batch):
        for k in batch.column(0).to_pylist():
            yield np.concatenate([np.random.default_rng(k).integers(0, 2**64, each, np.uint64), np.arange(1, 4, dtype=np.uint64) << np.uint64(61)])

    own = np.random.default_rng(3).integers(0, 2**64, each, np.uint64)
    sent = sketch.sliced_keys(spark.range(n, numPartitions=3), keys_of, n * each)
    twice = spark.range(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([float((sent.level(own) == 0).mean())]), pa.array([int(sent.level(np.arange(1, 4, dtype=np.uint64) << np.uint64(61)).min())])], names=["single", "least"]) for _ in bs), "single double, least long").first()
    assert len(sent.parts) == 8 and twice["least"] == 1 and twice["single"] > 0.4
    sent.destroy()


def test_components_by_slices(spark, docs, pairs, monkeypatch):
    monkeypatch.setattr(sketch, "MOST_BITS", 20)
    monkeypatch.setattr(sketch, "LEAST_BITS", 22)
    assert sorted(map(tuple, jaccard_join(docs).collect()), key=str) == sorted(brute.jaccard_join(pairs), key=str)
