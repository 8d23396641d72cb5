"""Conflicts, resolution strategies, and merges of graphs and of three versions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import clocks

from .mutate import merged

#: Columns of a pair of versions: value, clock and node of local and remote.
Strategy = Callable[[], Column]


def last_write_wins(local_clock="local_clock", remote_clock="remote_clock", local_node="local_node", remote_node="remote_node") -> Column:
    """'local' or 'remote': the later write; of concurrent or equal ones that of the larger node id."""
    c = clocks.compare(local_clock, remote_clock)
    return F.when(c == 1, "local").when(c == -1, "remote").when(F.col(local_node) > F.col(remote_node), "local").otherwise("remote")


def first_write_wins(local_clock="local_clock", remote_clock="remote_clock") -> Column:
    """The earlier write; of concurrent or equal ones the local."""
    return F.when(clocks.compare(local_clock, remote_clock) == 1, "remote").otherwise("local")


def source_priority(local_priority="local_priority", remote_priority="remote_priority", **names) -> Column:
    """That of the node with the higher priority; of equal ones the last write."""
    l, r = F.coalesce(local_priority, F.lit(0)), F.coalesce(remote_priority, F.lit(0))
    return F.when(l > r, "local").when(r > l, "remote").otherwise(last_write_wins(**names))


def multi_value() -> Column:
    """Both versions, each with its clock and node."""
    one = lambda side: F.struct(F.col(f"{side}_value").alias("value"), F.col(f"{side}_clock").alias("clock"), F.col(f"{side}_node").alias("source"))
    return F.array(one("local"), one("remote"))


def resolve(conflicts: DataFrame, default: str = "last_write_wins", by_property: Mapping[str, str] | None = None, priorities: Mapping[str, int] | None = None, custom: Column | None = None) -> DataFrame:
    """conflicts (target_id, path, local_*/remote_* value, clock, node) with strategy, winner and value.

    A property's strategy is named by the last part of its path, else the default. multi_value has no winner, and its
    value is both, comma-joined; custom takes the value that the given column has.
    """
    chosen = F.lit(default)
    for prop, strategy in (by_property or {}).items():
        chosen = F.when(F.col("path") == f"/properties/{prop}", F.lit(strategy)).otherwise(chosen)
    rank = F.lit(0)
    known = F.create_map(*[F.lit(x) for kv in (priorities or {"": 0}).items() for x in kv])
    df = conflicts.withColumn("strategy", chosen).withColumns({f"{s}_priority": F.coalesce(F.try_element_at(known, F.col(f"{s}_node")), rank) for s in ("local", "remote")})
    winner = (
        F.when(F.col("strategy") == "last_write_wins", last_write_wins())
        .when(F.col("strategy") == "first_write_wins", first_write_wins())
        .when(F.col("strategy") == "source_priority", source_priority())
    )
    df = df.withColumn("winner", winner)
    both = F.array_join(F.array_sort(F.array_distinct(F.array("local_value", "remote_value"))), ",")
    value = F.when(F.col("winner") == "local", F.col("local_value")).when(F.col("winner") == "remote", F.col("remote_value"))
    value = value.when(F.col("strategy") == "multi_value", both)
    if custom is not None:
        value = value.when(F.col("strategy") == "custom", custom)
    return df.withColumn("value", value).drop("local_priority", "remote_priority")


def auto_resolve(conflicts: DataFrame, **options) -> DataFrame:
    """Conflicts (with `resolved`) that aren't resolved yet, resolved; the others keep their value."""
    done = resolve(conflicts.withColumnRenamed("value", "_value") if "value" in conflicts.columns else conflicts.withColumn("_value", F.lit(None).cast("string")), **options)
    return done.withColumn("value", F.when(F.col("resolved"), F.col("_value")).otherwise(F.col("value"))).withColumn("resolved", F.lit(True)).drop("_value")


def detect(ops: DataFrame) -> DataFrame:
    """Pairs of operations on one target with concurrent clocks and a path in common: target_id, op_a, op_b, path.

    ops: op_id, target_id, clock, paths (array). Operations meet by target and path, so only pairs that
    share a path are compared; path is the first of the earlier operation's that both have.
    """
    one = ops.select("op_id", "target_id", "clock", "paths", F.explode(F.array_distinct("paths")).alias("p"))
    a, b = one.alias("a"), one.alias("b")
    pairs = a.join(b, (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.op_id") < F.col("b.op_id")))
    pairs = pairs.where(clocks.compare(F.col("a.clock"), F.col("b.clock")).isNull())
    first = F.element_at(F.array_intersect(F.col("a.paths"), F.col("b.paths")), 1)
    return pairs.select(F.col("a.target_id").alias("target_id"), F.col("a.op_id").alias("op_a"), F.col("b.op_id").alias("op_b"), first.alias("path")).distinct()


def merge_entities(local: DataFrame, remote: DataFrame) -> DataFrame:
    """By id: the higher version; equal versions get both sides' properties, local ones on top, and a version more."""
    names = local.columns
    l = local.select(F.col("id"), F.struct(*[F.col(c) for c in names]).alias("l"))
    r = remote.select(F.col("id"), F.struct(*[F.col(c) for c in names]).alias("r"))
    both = l.join(r, "id", "full_outer")
    tie = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l.version") == F.col("r.version"))
    left = F.col("l").isNotNull() & (F.col("r").isNull() | (F.col("l.version") >= F.col("r.version")))
    pick = lambda c: F.when(left, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}"))
    out = {c: pick(c).alias(c) for c in names}
    out["properties"] = F.when(tie, merged("r.properties", "l.properties")).otherwise(pick("properties")).alias("properties")
    out["version"] = F.when(tie, F.col("l.version") + 1).otherwise(pick("version")).alias("version")
    return both.select(*out.values())


def merge_relations(local: DataFrame, remote: DataFrame) -> DataFrame:
    """By id: the one updated later; of equal ones the remote."""
    names = local.columns
    l = local.select(F.col("id"), F.struct(*[F.col(c) for c in names]).alias("l"))
    r = remote.select(F.col("id"), F.struct(*[F.col(c) for c in names]).alias("r"))
    left = F.col("r").isNull() | (F.col("l").isNotNull() & (F.col("l.updated_at") > F.col("r.updated_at")))
    return l.join(r, "id", "full_outer").select(*[F.when(left, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in names])


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, value, conflict of frames (key, value): what one side changed wins; where both did, differently, local stays."""
    rows = local.select("key", F.col("value").alias("l")).join(remote.select("key", F.col("value").alias("r")), "key", "full_outer").join(base.select("key", F.col("value").alias("b")), "key", "full_outer")
    same, ours, theirs = F.col("l").eqNullSafe(F.col("r")), F.col("l").eqNullSafe(F.col("b")), F.col("r").eqNullSafe(F.col("b"))
    value = F.when(~same & ours, F.col("r")).otherwise(F.col("l"))
    return rows.select("key", value.alias("value"), (~same & ~ours & ~theirs).alias("conflict"))
