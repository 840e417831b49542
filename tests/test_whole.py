"""Queries over whole texts and all rows."""

import os

import pytest
from test_queries import SF

import corpusmetrics.plans  # noqa: F401
from corpusmetrics.registry import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_strings_are_whole(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("avg(length(text)) AS m").first()["m"]
    got = QUERIES["string_diagnostics"](spark, SF).selectExpr("sum(n * mean_length) / sum(n) AS m").first()["m"]
    assert got == pytest.approx(texts, rel=1e-6)


def test_facets_hold_all_tokens_and_orders(spark):
    import re

    got = QUERIES["distinct_n"](spark, SF).toPandas()
    assert sorted(got.n.unique()) == [1, 2, 3, 4, 5, 6]
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    tokens = sum(len(re.findall("[a-z0-9]+(?:[-'][a-z0-9]+)*", t.lower())) for t in texts)
    assert got[(got.n == 1) & (got.facet == "combined")].total.sum() == tokens


def test_calls_explode_to_all_turns(spark):
    got = QUERIES["call_explosion"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert got.turn.max() >= 3 and got.sample_index.is_unique
