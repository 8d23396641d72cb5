"""Similarity of array columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(v: Column, q: Column) -> Column:
    return _sum(F.zip_with(v, q, lambda a, b: a * b))


def cosine(v: Column, q: Column, q_norm: float | Column) -> Column:
    """0 where a norm is 0. The norm of a fixed vector is given, so it isn't computed for each row."""
    norm = F.sqrt(_sum(F.transform(v, lambda a: a * a))) * q_norm
    return F.when(norm == 0, 0.0).otherwise(dot(v, q) / F.when(norm == 0, 1.0).otherwise(norm))


def euclidean(v: Column, q: Column) -> Column:
    return 1 / (1 + F.sqrt(_sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))))


def literal(values: list[float]) -> tuple[Column, float]:
    """A fixed vector as a column, and its norm."""
    return F.array(*[F.lit(float(x)) for x in values]), math.sqrt(sum(float(x) ** 2 for x in values))


def score(v: Column, values: list[float], metric: str = "cosine") -> Column:
    q, norm = literal(values)
    if metric == "cosine":
        return cosine(v, q, norm)
    if metric == "euclidean":
        return euclidean(v, q)
    if metric == "dotProduct":
        return dot(v, q)
    raise ValueError(f"unknown metric: {metric}")


def sparse_dot(a: Column, b: Column) -> Column:
    """Of map<int, double> vectors."""
    return _sum(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))))
