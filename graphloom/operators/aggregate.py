"""Grouped aggregation over dotted paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import resolve, where

from .traverse import Condition

PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


@dataclass(frozen=True)
class Aggregation:
    name: str
    type: str
    field: str
    options: dict = field(default_factory=dict)


def column(df: DataFrame, a: Aggregation) -> Column:
    """Nulls don't count. A sum or mean of nothing is 0, a least or largest is null."""
    numeric = a.type in ("sum", "avg", "min", "max", "percentiles")
    c = resolve(df, a.field, 0.0 if numeric else None)
    if a.type == "count":
        return F.count(c)
    if a.type == "sum":
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    if a.type == "avg":
        return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    if a.type == "min":
        return F.min(c)
    if a.type == "max":
        return F.max(c)
    if a.type == "cardinality":
        return F.approx_count_distinct(c) if a.options.get("approximate") else F.countDistinct(c)
    if a.type == "percentiles":
        at = list(a.options.get("percentiles", PERCENTILES))
        if a.options.get("approximate"):
            return F.percentile_approx(c, at, a.options.get("accuracy", 10000))
        return F.percentile(c, F.array(*map(F.lit, at)))
    raise ValueError(f"unknown aggregation: {a.type}")


def aggregate(df: DataFrame, aggregations: Sequence[Aggregation], group_by: Sequence[str] = (), filters: Condition = None) -> DataFrame:
    """All aggregations in one pass, per group; groups are named after the last part of their path."""
    df = where(df, filters)
    keys = [resolve(df, p).alias(p.rpartition(".")[2]) for p in group_by]
    return df.groupBy(*keys).agg(*[column(df, a).alias(a.name) for a in aggregations])


def as_rows(df: DataFrame, aggregations: Sequence[Aggregation], filters: Condition = None) -> DataFrame:
    """name, type, value rows of scalar aggregations, still in one pass."""
    one = aggregate(df, aggregations, (), filters)
    rows = F.array(*[F.struct(F.lit(a.name).alias("name"), F.lit(a.type).alias("type"), F.col(a.name).cast("double").alias("value")) for a in aggregations])
    return one.select(F.inline(rows))


def histogram(df: DataFrame, path: str, interval: float, filters: Condition = None) -> DataFrame:
    """bucket (lower bound, a multiple of interval), count; values that are null aren't counted."""
    df = where(df, filters)
    value = resolve(df, path, 0.0).cast("double")
    return df.select((F.floor(value / interval) * interval).cast("double").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("count"))


def stats(df: DataFrame) -> DataFrame:
    """type, count; soft-deleted rows count too."""
    return df.groupBy("type").agg(F.count("*").alias("count"))
