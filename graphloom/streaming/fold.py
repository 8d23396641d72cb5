"""Streams: the fold of an operation log with state per target, messages each once, windows of events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import clocks
from graphloom.operators import oplog

OUTPUT = "target_id string, deleted boolean, present boolean, n_applied long, props string"
STATE = "deleted boolean, present boolean, n_applied long, clock string, props string, history long, deleted_at long"


def _clock(text: str | None) -> dict[str, int]:
    return {k: int(v) for k, _, v in (x.rpartition("=") for x in (text or "").split(",") if x)}


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    deleted, present, n, clock, props, history, gone_at = state.get if state.exists else (False, False, 0, "", "{}", 0, -1)
    now = (present, deleted, json.loads(props), _clock(clock), history, None if gone_at < 0 else gone_at)
    for op in pd.concat(list(frames)).sort_values("seq").itertuples():
        payload, patches = (json.loads(x) if isinstance(x, str) else None for x in (op.payload, op.patches))
        new = oplog.step(now, op.type, _clock(op.clock), payload, [{"op": None, "path": None, "value": None} | p for p in patches or ()], None if pd.isna(op.deleted_at) else int(op.deleted_at))
        n += new is not now
        now = new
    present, deleted, props, clock, history, gone_at = now
    text = json.dumps(props, sort_keys=True)
    state.update((deleted, present, n, ",".join(f"{k}={v}" for k, v in sorted(clock.items())), text, history, -1 if gone_at is None else gone_at))
    yield pd.DataFrame([(key[0], deleted, present, n, text)], columns=["target_id", "deleted", "present", "n_applied", "props"])


def fold_stream(ops: DataFrame) -> DataFrame:
    """ops: a stream of operations as `as_messages` makes them; each is applied as oplog.fold applies it (oplog.step).

    Emits each target's state whenever operations on it arrive. Within a micro-batch they are taken by seq.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return ops.groupBy("target_id").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def as_messages(ops: DataFrame) -> DataFrame:
    """An operation log as flat rows that a file stream can carry: clock ('node=count,...'), payload and patches (JSON)."""
    gone = F.col("tombstone.deleted_at").alias("deleted_at")
    return ops.select("target_id", "seq", "type", clocks.text("clock").alias("clock"), F.to_json("payload").alias("payload"), F.to_json("patches").alias("patches"), gone)


def written(states: DataFrame, folder: str, available: bool = True, interval: str = "5 seconds"):
    """Starts the stream of states into `folder`: each micro-batch as Parquet under its number, so one that is repeated after a failure replaces itself.

    Takes what is there and ends, or with available=False goes on, a batch per interval.
    """
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/states/batch={n}")
    out = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint")
    return (out.trigger(availableNow=True) if available else out.trigger(processingTime=interval)).start()


def last_states(spark, folder: str) -> DataFrame:
    """The last state of each target that such a stream has written."""
    rows = spark.read.schema(f"{OUTPUT}, batch long").parquet(f"{folder}/states")
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    return rows.groupBy("target_id").agg(F.max_by(F.struct(*names[1:]), "batch").alias("s")).select("target_id", "s.*")


def deduplicated(messages: DataFrame, key: str = "msg_id", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """A stream of messages, each once. With a time column the state forgets ids older than `late`."""
    ready = messages.where("causally_ready")
    if time is None:
        return ready.dropDuplicates([key])
    return ready.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def _counted(events: DataFrame, window, time: str, late: str, keys: tuple[str, ...], ends: bool) -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *([F.col("window.end").alias("end")] if ends else []), *keys, "n")


def tumbling(events: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour", *keys: str) -> DataFrame:
    """Counts per window of a stream or a table; a stream drops what comes later than `late`."""
    return _counted(events, F.window(time, width), time, late, keys, False)


def sliding(events: DataFrame, time: str, width: str = "2 hours", every: str = "1 hour", late: str = "1 hour", *keys: str) -> DataFrame:
    """Counts per window of `width`, one beginning every `every`; an event counts in each window that it falls in."""
    return _counted(events, F.window(time, width, every), time, late, keys, False)


def sessions(events: DataFrame, time: str, gap: str = "30 minutes", late: str = "1 hour", *keys: str) -> DataFrame:
    """Counts per session of each key: events less than `gap` apart. A session ends `gap` after its last event."""
    return _counted(events, F.session_window(time, gap), time, late, keys, True)
