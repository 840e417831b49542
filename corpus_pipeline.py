"""From raw documents to packed training sequences, in stages that each work on all that the one before kept.

Defined results of every stage: rows with null ids or texts, empty and very long texts, ties, repeated rows, empty
tables and extra columns with clashing names are handled as the operator of the stage states; extra columns are
carried along by all stages but the last, which returns pieces.  Null texts leave the suffix stage as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmetrics.llm.exact_dedup import exact_survivors
from corpusmetrics.llm.jaccard_join import jaccard_survivors
from corpusmetrics.llm.packing import best_fit_packing
from corpusmetrics.llm.queries import crc_mod, table, tokenizer
from corpusmetrics.llm.shared import drop, stored
from corpusmetrics.llm.suffix_dedup import suffix_deduped
from corpusmetrics.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents flagged by the classifier go."""
    return not_toxic(docs, table(spark, sf_dir, "labels"), crc_mod(4) != 2)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest doc_id stays."""
    return exact_survivors(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the least doc_id stays."""
    return jaccard_survivors(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that stand earlier too are cut out of the texts; every document stays."""
    return suffix_deduped(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return best_fit_packing(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit),
]

#: A trained classifier can't be stated in SQL; the tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; between stages, what is kept is written and read back."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
            if before is not None:  # all that read it is written
                drop(before)
            before = docs
    return docs
