"""Operation logs: builders, the fold into state, delivery to peers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import clocks

RETENTION_MS = 30 * 24 * 3600 * 1000
PATCH = "array<struct<op:string,path:string,value:string>>"
#: Paths of patches that have an effect.
_KEY = re.compile(r"/(?:properties/)?([^/]+)")


def tombstone(target_id: Column, node_id: Column, now: Column) -> Column:
    return F.struct(target_id.alias("id"), now.cast("long").alias("deleted_at"), node_id.alias("deleted_by"), (now + RETENTION_MS).cast("long").alias("gc_after"))


def operation(kind: str, seq: Column, target_id: Column, node_id: Column, clock: Column, payload: Column | None = None, patches: Column | None = None, now: Column | None = None) -> list[Column]:
    """Columns of one operation; kind is <entity|relation>_<add|update|delete>."""
    if kind not in {f"{a}_{b}" for a in ("entity", "relation") for b in ("add", "update", "delete")}:
        raise ValueError(f"unknown operation: {kind}")
    now = F.lit(0) if now is None else now
    none = F.lit(None)
    return [
        seq.alias("seq"),
        F.lit(kind).alias("type"),
        target_id.alias("target_id"),
        node_id.alias("node_id"),
        clock.alias("clock"),
        F.lit(True).alias("causally_ready"),
        (none.cast("map<string,string>") if payload is None else payload).alias("payload"),
        (none.cast(PATCH) if patches is None else patches).alias("patches"),
        (tombstone(target_id, node_id, now) if kind.endswith("delete") else none.cast("struct<id:string,deleted_at:bigint,deleted_by:string,gc_after:bigint>")).alias("tombstone"),
    ]


def patched(props: Column, patches: Column) -> Column:
    """Properties after JSON patches: replace, add and remove of /<key> or /properties/<key>; others do nothing."""

    def one(acc: Column, p: Column) -> Column:
        key = F.regexp_extract(p["path"], r"^/(?:properties/)?([^/]+)$", 1)
        sets = p["op"].isin("replace", "add") & (key != "")
        drops = (p["op"] == "remove") & (key != "")
        on_top = F.map_zip_with(acc, F.create_map(key, p["value"]), lambda _, a, b: F.coalesce(b, a))
        return F.when(sets, on_top).when(drops, F.map_filter(acc, lambda k, _: k != key)).otherwise(acc)

    none = F.create_map().cast("map<string,string>")
    return F.aggregate(F.coalesce(patches, F.array().cast(PATCH)), F.coalesce(props, none), one)


def deliverable(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """Messages that are causally ready, each once."""
    return messages.where("causally_ready").dropDuplicates([key])


def latest(ops: DataFrame) -> DataFrame:
    """The state of each target when an op's clock decides, independent of arrival: target_id, deleted, value of the last write.

    ops: target_id, node_id, clock, type, and counter, the sum of the clock: an op that comes after another has a larger
    one. Of concurrent ops the larger (counter, node_id) counts, so replicas agree. Deletion dominates.
    """
    is_delete = F.col("type").endswith("_delete")
    order = F.struct("counter", "node_id", "seq")
    rows = ops.withColumn("counter", F.aggregate(F.map_values("clock"), F.lit(0).cast("long"), lambda a, x: a + x))
    best = F.max_by("value", F.when(~is_delete, order))
    return rows.groupBy("target_id").agg(F.max(is_delete).alias("deleted"), best.alias("value"), F.count("*").alias("n_ops"))


#: What the fold knows of a target, in this order: its entity is there, it is deleted, its properties, the clock of the last change.
NEW = (False, False, {}, {}, 0, None)


def step(state: tuple, kind: str, clock: dict, payload: dict | None, patches: list | None, deleted_at: int | None) -> tuple:
    """One operation on one target's state, in order of arrival.

    An add makes the entity, or replaces it if its clock is newer or concurrent. An update needs an entity that isn't
    deleted and a newer or concurrent clock; the old version counts as history. A delete leaves a tombstone even for
    an unknown target, if newer or concurrent. Deletion sticks: a later add changes what is stored, but not that.
    """
    present, deleted, props, last, history, gone_at = state
    newer = any(v > last.get(k, 0) for k, v in clock.items())
    takes = newer or not (present or deleted)
    if kind.endswith("_add") and takes:
        return True, deleted, dict(payload or {}), clock, history, gone_at
    if kind.endswith("_update") and present and not deleted and newer:
        props = dict(props)
        for p in patches or ():
            found = _KEY.fullmatch((p or {}).get("path") or "")
            if found and p["op"] in ("replace", "add"):
                if p["value"] is not None or found[1] not in props:
                    props[found[1]] = p["value"]
            elif found and p["op"] == "remove":
                props.pop(found[1], None)
        return present, deleted, props, clock, history + 1, gone_at
    if kind.endswith("_delete") and takes:
        return present, True, props, clock, history, deleted_at
    return state


_FOLDED = "present boolean, deleted boolean, props map<string,string>, clock map<string,bigint>, history bigint, deleted_at bigint"


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations sorted by target and seq -> a state per target. One state is held at a time, however many operations it has."""
    schema = pa.schema([("target_id", pa.string()), ("present", pa.bool_()), ("deleted", pa.bool_()), ("props", pa.map_(pa.string(), pa.string())), ("clock", pa.map_(pa.string(), pa.int64())), ("history", pa.int64()), ("deleted_at", pa.int64())])
    done: list[tuple] = []
    target, state, some = None, NEW, False

    def out() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*done, strict=True)]
        for k in (3, 4):
            columns[k] = [list(m.items()) for m in columns[k]]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for t, kind, clock, payload, patches, deleted_at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if some and t != target:
                done.append((target, *state))
                state = NEW
                if len(done) >= 10_000:
                    yield out()
            target, some = t, True
            state = step(state, kind or "", dict(clock or ()), dict(payload) if payload is not None else None, patches, deleted_at)
    if some:
        done.append((target, *state))
    if done:
        yield out()


def fold(ops: DataFrame) -> DataFrame:
    """target_id and its state after all its operations in order of seq. Each target is folded on its own.

    Operations are dealt by target and sorted by Spark, which spills; a task then goes through them with one state at a time,
    so a target with very many operations takes time, but no memory. Operations of one seq are taken in order of node and clock.
    """
    rows = ops.select("target_id", "type", "clock", "payload", "patches", F.col("tombstone.deleted_at").alias("deleted_at"), "seq", "node_id", clocks.text("clock").alias("_clock"))
    dealt = rows.repartition("target_id").sortWithinPartitions("target_id", "seq", "node_id", "_clock").drop("seq", "node_id", "_clock")
    return dealt.mapInArrow(_folds, f"target_id string, {_FOLDED}")


def active(state: DataFrame) -> DataFrame:
    return state.where("present and not deleted")


def ops_for_peer(ops: DataFrame, peers: DataFrame) -> DataFrame:
    """peer_id with each operation that its clock hasn't seen: after it or concurrent. Peers are few, and broadcast if so."""
    few = peers.limit(10_001).count() <= 10_000
    p = peers.select("peer_id", F.col("clock").alias("peer_clock"))
    return ops.join(F.broadcast(p) if few else p, clocks.newer_or_concurrent("clock", "peer_clock"))


def advance(peers: DataFrame, seen: DataFrame) -> DataFrame:
    """Peers with their clocks merged with those of seen (peer_id, clock), and idle."""
    s = seen.select("peer_id", F.col("clock").alias("_seen"))
    return peers.join(s, "peer_id", "left").withColumn("clock", clocks.merge("clock", "_seen")).withColumn("status", F.lit("idle")).drop("_seen")


def _drawn(*parts: Column) -> Column:
    """A number of 60 bits that hangs on the parts, by md5: other engines give the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def numbered(peers: DataFrame, buckets: int = 1024) -> DataFrame:
    """peer_id and number, from 0 without gaps: within buckets by hash, each after the buckets before. Equal ids count once."""
    known = peers.select("peer_id").distinct().withColumn("bucket", F.pmod(_drawn(F.col("peer_id")), F.lit(buckets)))
    sizes = known.groupBy("bucket").count()
    # As many rows as buckets at most.
    base = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("base"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("peer_id"))
    return known.withColumn("n", within).join(F.broadcast(base), "bucket").select("peer_id", (F.col("base") + F.col("n") - 1).alias("number"))


def fanout(messages: DataFrame, peers: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """msg_id, peer_id: each message to n peers, or to all if they are fewer, chosen by hashes of the message.

    Peers are numbered, and a message draws n different numbers (Floyd's way), so every set of peers is as likely
    and no message meets all peers. Peers are broadcast if few; their count is not bounded.
    """
    total = peers.select("peer_id").distinct().count()
    take = max(0, min(n, total))
    drawn = F.array().cast("array<bigint>")
    for top in range(total - take, total):
        pick = F.pmod(_drawn(F.col("msg_id"), F.lit(seed), F.lit(total - top)), F.lit(top + 1)).cast("long")
        drawn = _with_one(drawn, pick, top)
    pairs = messages.select("msg_id").distinct().select("msg_id", F.explode(drawn).alias("number"))
    known = numbered(peers)
    return pairs.join(F.broadcast(known) if total <= 10_000 else known, "number").select("msg_id", "peer_id")


def _with_one(drawn: Column, pick: Column, top: int) -> Column:
    """drawn with pick, or with top if pick is in it."""
    return F.transform(F.array(F.struct(drawn.alias("d"), pick.alias("p"))), lambda x: F.concat(x["d"], F.array(F.when(F.array_contains(x["d"], x["p"]), F.lit(top).cast("long")).otherwise(x["p"]))))[0]


def collected(tombstones: DataFrame, now: Column) -> DataFrame:
    """Tombstones that are still to be kept."""
    return tombstones.where(F.col("gc_after") > now)


def version_gaps(ops: DataFrame) -> DataFrame:
    """Operations whose prior_version isn't the new_version of the one before on the same target."""
    before = F.lag("new_version").over(Window.partitionBy("target_id").orderBy("seq"))
    return ops.withColumn("expected", before).where("expected is not null and prior_version <> expected")


#: A new peer's priority, and milliseconds between its rounds.
PRIORITY, INTERVAL_MS = 1, 5000


def register(peers: DataFrame | None, new: DataFrame) -> DataFrame:
    """The registry (peer_id, clock, priority, interval_ms, status) with new peers (peer_id and any of the others).

    A known peer keeps its clock and gets what is told of it; a peer told twice counts once, the one of higher priority.
    """
    defaults = {"clock": F.create_map().cast("map<string,bigint>"), "priority": F.lit(PRIORITY), "interval_ms": F.lit(INTERVAL_MS), "status": F.lit("idle")}
    told = new.withColumns({k: v for k, v in defaults.items() if k not in new.columns}).select("peer_id", *defaults)
    first = Window.partitionBy("peer_id").orderBy(F.desc("priority"), "interval_ms", "status")
    told = told.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if peers is None:
        return told
    old = peers.select("peer_id", F.col("clock").alias("_clock"), F.lit(True).alias("_old"))
    kept = told.join(old, "peer_id", "left").withColumn("clock", F.when(F.col("_old"), clocks.merge("_clock", "clock")).otherwise(F.col("clock"))).select("peer_id", *defaults)
    return peers.select("peer_id", *defaults).join(told.select("peer_id"), "peer_id", "left_anti").unionByName(kept)


def without_peers(peers: DataFrame, gone: DataFrame) -> DataFrame:
    return peers.join(gone.select("peer_id"), "peer_id", "left_anti")


def clock_of(ops: DataFrame) -> DataFrame:
    """One row: what a replica that has seen ops knows of each node, as a clock."""
    entry = ops.select(F.explode("clock").alias("node", "n")).groupBy("node").agg(F.max("n").alias("n"))
    return entry.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "n")))).alias("clock"))  # a row per node


def received(log: DataFrame, remote: DataFrame, key: Sequence[str] = ("node_id", "target_id", "seq")) -> DataFrame:
    """The log with remote operations: those that are causally ready and not in it yet, each once. Refolding it applies them."""
    new = remote.where("causally_ready").dropDuplicates(list(key)).join(log.select(*key), list(key), "left_anti")
    return log.unionByName(new, allowMissingColumns=True)


def sync_status(peers: DataFrame, ops: DataFrame) -> DataFrame:
    """peer_id, status, priority, pending (operations that it hasn't seen) and in_sync, for every peer of a registry."""
    waiting = ops_for_peer(ops, peers).groupBy("peer_id").agg(F.count("*").alias("pending"))
    rows = peers.select("peer_id", "status", "priority").join(waiting, "peer_id", "left")
    pending = F.coalesce("pending", F.lit(0)).cast("long")
    return rows.select("peer_id", "status", "priority", pending.alias("pending"), (pending == 0).alias("in_sync"))


def gossip_round(log: DataFrame, peers: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """What one round sends: peer_id and the operations that it lacks, of n peers drawn for the round. A trigger calls it in place of a timer."""
    chosen = fanout(peers.sparkSession.range(1).select(F.lit(0).alias("msg_id")), peers, n, seed).select("peer_id")
    return ops_for_peer(log, peers.join(chosen, "peer_id", "left_semi"))
