"""Vector clocks as map<string, bigint> columns; a node that a clock lacks counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _map(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.create_map().cast("map<string,bigint>"))


def _any(a: Column, b: Column) -> Column:
    """Whether a is ahead of b for some node."""
    zero = F.lit(0).cast("long")
    return F.exists(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) > F.coalesce(y, zero))), lambda v: v)


def compare(a: Column | str, b: Column | str) -> Column:
    """-1: a is before b; 1: after; 0: equal; null: concurrent."""
    a, b = _map(a), _map(b)
    ahead, behind = _any(a, b), _any(b, a)
    return F.when(ahead & behind, F.lit(None).cast("int")).when(ahead, 1).when(behind, -1).otherwise(0)


def happens_before(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(compare(a, b) == -1, F.lit(False))


def newer_or_concurrent(a: Column | str, b: Column | str) -> Column:
    """Whether a is after b or neither is: what a change needs to take effect over b."""
    return F.coalesce(compare(a, b) == 1, F.lit(True))


def merge(a: Column | str, b: Column | str) -> Column:
    zero = F.lit(0).cast("long")
    return F.map_zip_with(_map(a), _map(b), lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def increment(clock: Column | str, node: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.map_zip_with(_map(clock), F.create_map(node, F.lit(1).cast("long")), lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def text(clock: Column | str) -> Column:
    """A clock as 'node=count' in order of nodes."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_map(clock))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
