"""Integrity as tables of violations (empty when all is well), and assertions on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import AXES, LABELS, STRATA


class IntegrityError(ValueError):
    pass


def require_empty(violations: DataFrame, what: str) -> None:
    if found := violations.take(3):
        raise IntegrityError(f"{what}: {found}")


def invalid_labels(judged: DataFrame) -> DataFrame:
    """Judgments with a label, an order or a stratum that there is not."""
    one_of = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    return judged.where(~(one_of("answer", LABELS) & one_of("order", ("ab", "ba")) & one_of("stratum", STRATA)))


def invalid_scores(scores: DataFrame, axes: Sequence[str] = AXES, lo: int = 1, hi: int = 10) -> DataFrame:
    inside = [F.coalesce(F.col(a).between(lo, hi), F.lit(False)) for a in axes]
    return scores.where(~reduce(lambda a, b: a & b, inside))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def one_to_one(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join of two tables whose keys are unique; raises where they aren't."""
    for df in (a, b):
        require_empty(duplicate_keys(df, key), f"keys {list(key)} are not unique")
    return a.join(b, list(key))


def unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df, whose key must be unique: the query fails where it isn't.  One aggregation on the key, as a join on it needs anyway."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in rest))
    error = F.raise_error(F.concat(F.lit(f"keys {list(key)} are not unique: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in key))))
    return one.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(error.cast("boolean"))).select(*df.columns)


def key_set_diff(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of only one of the tables, and of which."""
    x = a.select(*key).distinct().withColumn("__a", F.lit(True))
    y = b.select(*key).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right")
    return x.join(y, list(key), "full").select(*key, side.alias("only_in")).where("only_in is not null")


def misaligned(records: DataFrame, keys: DataFrame, key: Sequence[str], index: str = "row_idx") -> DataFrame:
    """Rows whose key differs between two tables of (index, key), or that one of them lacks."""
    a = records.select(index, F.struct(*key).alias("record_key"))
    b = keys.select(index, F.struct(*key).alias("matrix_key"))
    return a.join(b, index, "full").where(~F.col("record_key").eqNullSafe(F.col("matrix_key")))


def uneven_groups(df: DataFrame, group: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Groups whose size differs from the commonest one (the larger of equals)."""
    sizes = df.groupBy(*within, *group).agg(F.count("*").alias("n"))
    common = sizes.groupBy(*within, "n").agg(F.count("*").alias("c"))
    best = common.groupBy(*within).agg(F.max(F.struct("c", "n")).alias("m")) if within else common.agg(F.max(F.struct("c", "n")).alias("m"))
    best = best.select(*within, F.col("m.n").alias("expected"))
    joined = sizes.join(best, list(within)) if within else sizes.crossJoin(F.broadcast(best))
    return joined.where("n <> expected")


def out_of_range(df: DataFrame, value: str, lo: float, hi: float, slack: float = 1e-9) -> DataFrame:
    return df.where((F.col(value) < lo - slack) | (F.col(value) > hi + slack) | F.isnan(value) | F.col(value).isNull())


def incompatible(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields in which two one-row manifests differ."""
    cells = lambda df, n: df.limit(1).select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(n)) for f in fields))).alias("c")).select("c.*")
    return cells(a, "was").join(cells(b, "now"), "field").where(~F.col("was").eqNullSafe(F.col("now")))


def completeness(samples: DataFrame, keywords: DataFrame, per_keyword: int, index: str = "sample_index") -> DataFrame:
    """check, violations: duplicates, missing and unknown keywords, wrong counts of a keyword, wrong total."""
    dup = duplicate_keys(samples, ["keyword", index]).agg(F.count("*").alias("violations")).select(F.lit("duplicates").alias("check"), "violations")
    diff = key_set_diff(keywords, samples, ["keyword"])
    missing = diff.agg(F.count_if(F.col("only_in") == "left").alias("violations")).select(F.lit("missing_keywords").alias("check"), "violations")
    unknown = diff.agg(F.count_if(F.col("only_in") == "right").alias("violations")).select(F.lit("unknown_keywords").alias("check"), "violations")
    sizes = samples.groupBy("keyword").agg(F.count("*").alias("n"))
    wrong = sizes.agg(F.count_if(F.col("n") != per_keyword).alias("violations")).select(F.lit("wrong_counts").alias("check"), "violations")
    total = samples.agg(F.count("*").alias("n")).crossJoin(keywords.agg((F.countDistinct("keyword") * per_keyword).alias("e"))).select(F.lit("total_gap").alias("check"), F.abs(F.col("n") - F.col("e")).alias("violations"))
    return dup.unionByName(missing).unionByName(unknown).unionByName(wrong).unionByName(total)


def manifest_totals(samples: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: successes, failures and the success rate."""
    ok, bad = samples.agg(F.count("*").alias("n_success")), errors.agg(F.count("*").alias("n_error"))
    return ok.crossJoin(bad).withColumn("success_rate", F.when(F.col("n_success") + F.col("n_error") > 0, F.col("n_success") / (F.col("n_success") + F.col("n_error"))))
