"""Shared pieces of the training-data operators: scratch tables, size-checked joins, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources.scratch import folder as scratch

#: ASCII white space, the only separators that the word operators know.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join with at most so many short rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 50_000
#: Bytes of one text that are split into words at a time.
PIECE = 4 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand rows to Python by the thousand at most: rows here are whole texts.

    A setting of the session, that Spark reads when it plans an action; results are lazy, so it stays lowered. A session that
    needs larger batches elsewhere takes a session of its own (spark.newSession()) for these operators.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def save(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Cuts the lineage: whatever executor is lost later, these rows are read again, not computed again.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what save() wrote in this application; call it once results have been written out."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/graphloom-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_schema(kind: T.DataType, others: str) -> T.StructType:
    """doc_id of that type, then the columns that `others` tells in DDL."""
    return T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL(others).fields])


def packed(docs: DataFrame, text_col: str = "text", **more: str) -> DataFrame:
    """docs as _row, a struct of all columns, with its text (and more) besides: names in docs clash with nothing."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs[f"`{text_col}`"].alias("text"), *[docs[f"`{c}`"].alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, row: str = "_row") -> DataFrame:
    return df.select(*[F.col(row).getField(f.name).alias(f.name) for f in df.schema[row].dataType.fields])


def bounded(saved: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """saved with a broadcast hint if it has at most so many rows; else as it is, so that the join shuffles."""
    return F.broadcast(saved) if saved.limit(rows + 1).count() <= rows else saved


def pieces(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of some MB that end between words."""
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A uint64 hash of every n consecutive entries of h."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    factors = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out += h[i : len(h) - n + 1 + i] * factors[i]
    return mixed(out)


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive entries, by doubling."""
    span = 1
    while span * 2 <= n:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = n - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
