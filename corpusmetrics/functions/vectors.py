"""Vector expressions on array<double> columns; zero vectors are divided by one."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def unit(vec: Column) -> Column:
    # an expression within a lambda is evaluated for every element: the norm is bound first
    return F.get(F.transform(F.array(norm(vec)), lambda n: F.transform(vec, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))), 0)


def cosine_distance(u: Column, v: Column) -> Column:
    """Of unit vectors, clipped to [0, 2]."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(u, v)))


def vector_sum(vec: Column) -> Column:
    """Aggregate: the sum of arrays, kept as one buffer a group."""
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


def vector_mean(vec: Column) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


def mean_pair_distance(total: Column, squares: Column, n: Column) -> Column:
    """Mean of 1 - u.v over all pairs, from S = sum of unit vectors, q = sum of their squared norms; null for n < 2."""
    return F.when(n > 1, 1 - (dot(total, total) - squares) / (n * (n - 1)))


def mean_cross_distance(sum_a: Column, sum_b: Column, n_a: Column, n_b: Column) -> Column:
    return F.when((n_a > 0) & (n_b > 0), 1 - dot(sum_a, sum_b) / (n_a * n_b))
