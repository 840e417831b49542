"""The Merkle manifest against plain trees."""

import zlib

import brute
import pytest
from pyspark.sql import functions as F

from corpusmetrics.llm.merkle_manifest import merkle_manifest
from corpusmetrics.llm.queries import OP11_SQL, crc_mod, op11_merkle_manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def plain(docs) -> list[tuple]:
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    return sorted(brute.merkle(rows, lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0, lambda t: t.replace("\n", "")), key=repr)


def got(docs, **more) -> list[tuple]:
    out = merkle_manifest(docs, crc_mod(2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")), **more)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.fixture(scope="module")
def many(spark):
    """A source of 1,000 rows, some of three powers, one row, a null source, one named '' and odd values."""
    sizes = {"hot": 1000, "three": 3, "nine": 9, "ten": 10, "one": 1, None: 30, "": 2, "é": 28, "z": 81, "zz": 82}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 1
            rows.append((k * 37 % 1999, s, "en" if k % 3 else None, None if k % 7 == 0 else k, [None, "", "a\nb", "\n", "é\x00" * (k % 50), "line\n" * (k % 9)][k % 6]))
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equal_to_plain_trees(many, levels):
    """With few levels a bucket, the trees take several rounds."""
    want = plain(many)
    assert got(many, levels=levels) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)


def test_many_sources(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 200).alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("a\nb").alias("text"))
    assert got(docs, levels=2) == plain(docs)


def test_odd_rows(docs, odd, empty, spark):
    """Null ids come first and are not tampered with; repeated rows; ids of two texts; clashing columns; no rows."""
    assert got(docs) == plain(docs)
    assert got(odd) == plain(odd)
    assert got(odd, levels=1) == plain(odd)
    assert got(empty) == []
    one = spark.createDataFrame([(8, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(one) == plain(one) and plain(one)[0][4] == brute.sha(b"")


def test_many_equal_rows_and_long_texts(spark):
    """A third of the rows are one row; one text has two million characters."""
    rows = [(5, "s", "en", 1, "same\n")] * 300 + [(i, "s", "en", i, f"text {i}\n") for i in range(600)] + [(7000, "s", None, 1, "long\n" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert got(docs, levels=3) == plain(docs)


def test_query_and_sql(spark, tmp_path, many):
    import duckdb

    many.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op11_merkle_manifest(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        said = con.sql(OP11_SQL)
        assert said.columns == rows.columns
        assert sorted(said.fetchall(), key=repr) == sorted((tuple(r) for r in rows.collect()), key=repr) == plain(many)
