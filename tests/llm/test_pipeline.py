"""Stages of the pipeline against plain versions on their own inputs, and the queries' SQL."""

import os
from collections import defaultdict

import brute
import duckdb
import pytest

import corpus_pipeline as cp
from corpusmetrics.llm.queries import QUERIES, SQL
from corpusmetrics.llm.shared import stored

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        out = stored(stage(spark, docs, SF), "t")
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns
        if name == "exact_dedup":
            groups = defaultdict(list)
            for d, t in before:
                groups[t.translate(brute.AZ)].append(d)
            assert {r["doc_id"] for r in after} == {max(g) for g in groups.values()}
        if name == "ngram_jaccard_join":
            assert {r["doc_id"] for r in after} == {d for d, _, c in brute.jaccard_join(before) if d == c}
        if name == "suffix_array_dedup":
            plain = {r[0]: r for r in brute.suffix_dedup(before, 100)}
            same = [brute.sha(r["text"].encode()) == plain[r["doc_id"]][4] for r in after]
            assert len(after) == len(before) and sum(same) > 0.97 * len(same)
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in after} == {d for d, _ in before}
        docs = out


def test_pipeline_is_its_stages(spark):
    assert cp.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
