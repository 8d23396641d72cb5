"""What suffix and substring dedup share: stretches of rows' texts, told apart by digests, and decided by their ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, id_schema, save

#: Stretches that a task combines at a time; rows of a batch; spans, in all, of the rows that are broadcast.
HELD, OUT_ROWS, BROADCAST_SPANS = 1_000_000, 100_000, 100_000
#: kind of a row of references: a stretch to be decided, one known to be a repeat, or a key with several contents.
OPEN, KNOWN, MIXED = 0, 1, 2
_NAMES = ["id", "kind", "key", "d1", "d2", "row", "pos", "len"]


def reference_schema(kind: T.DataType) -> T.StructType:
    """Columns of references: id (of that type), kind, key, a digest in two longs, and where the stretch is."""
    out = id_schema(kind, "kind int, key long, d1 long, d2 long, row long, pos long, len int")
    return T.StructType([T.StructField("id", kind), *out.fields[1:]])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text, doc_id and row, a hash of both: (doc_id, row) tells rows apart, but for those that repeat id and text."""
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"))


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """128 bits of BLAKE2b of each part, as two uint64: nobody knows two contents that share them."""
    return np.frombuffer(b"".join([blake2b(p, digest_size=16).digest() for p in parts]), np.uint64).reshape(-1, 2)


def ranks(ids: pa.Array) -> np.ndarray:
    """Equal ids get equal numbers, larger ids larger ones; null counts as larger than all."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


class References:
    """Combines a task's stretches, some millions at a time, before they leave it."""

    def __init__(self, by_key: bool, limit: int | None = None):
        self.by_key, self.limit = by_key, HELD if limit is None else limit
        self.clear()

    def clear(self) -> None:
        self.docs: list[pa.Array] = []
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n_docs = self.size = 0

    def add(self, ids: pa.Array, rows: np.ndarray, doc: np.ndarray, key: np.ndarray, digest: np.ndarray, pos: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Stretches in the order of the text: the document of each (an index into ids and rows), key, digest, place."""
        self.docs.append(ids)
        self.held.append((doc + self.n_docs, rows[doc], key, digest[:, 0], digest[:, 1], pos, length))
        self.n_docs += len(ids)
        self.size += len(doc)
        if self.size >= self.limit:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        """What is held: of equal contents only those of the least id stay open, the others are known repeats.

        A key that has several contents here goes on as one row that says so; without by_key
        contents alone count.
        """
        if not self.size:
            return
        ids = pa.concat_arrays(self.docs)
        doc, row, key, d1, d2, pos, length = map(np.concatenate, zip(*self.held, strict=True))
        self.clear()
        rank = ranks(ids)[doc]
        order = np.lexsort((rank, d2, d1, key)) if self.by_key else np.lexsort((rank, d2, d1))
        k, a, b = key[order], d1[order], d2[order]
        new_content = np.ones(len(order), bool)
        new_content[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | ((k[1:] != k[:-1]) if self.by_key else False)
        least = rank[order][np.flatnonzero(new_content)][np.cumsum(new_content) - 1]
        known = np.zeros(len(order), bool)
        known[order] = rank[order] > least
        several = np.zeros(len(order), bool)
        if self.by_key:
            new_key = np.ones(len(order), bool)
            new_key[1:] = k[1:] != k[:-1]
            first = np.flatnonzero(new_key)
            contents = np.add.reduceat(new_content.astype(np.int64), first)
            several[order] = (contents > 1)[np.cumsum(new_key) - 1]
            none = np.zeros(int((contents > 1).sum()), np.int64)
            yield from self._rows(MIXED, pa.nulls(len(none), ids.type), k[first[contents > 1]], none, none, none, none, none)
        go = np.flatnonzero(~known & ~several)
        yield from self._rows(OPEN, ids.take(pa.array(doc[go])), key[go], d1[go], d2[go], row[go], pos[go], length[go])
        # Neighbours in the text that are both known become one.
        at = np.flatnonzero(known)
        if len(at):
            start = np.ones(len(at), bool)
            start[1:] = (doc[at[1:]] != doc[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + length[at[:-1]])
            s = np.flatnonzero(start)
            total = np.add.reduceat(length[at], s)
            x = at[s]
            zero = np.zeros(len(x), np.int64)
            yield from self._rows(KNOWN, ids.take(pa.array(doc[x])), row[x], row[x], zero, row[x], pos[x], total)

    @staticmethod
    def _rows(kind: int, ids: pa.Array, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(ids), OUT_ROWS):
            hi = min(len(ids), lo + OUT_ROWS)
            cut = [c[lo:hi] for c in columns]
            arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cut[:-1]]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.full(hi - lo, kind, np.int32)), *arrays, pa.array(cut[-1].astype(np.int32))], names=_NAMES)


def decided(references: DataFrame, by_key: bool) -> DataFrame:
    """id, row, pos, len of the stretches that a smaller id has; with by_key also a row with `mixed` for each key with several contents.

    Stretches were combined in the tasks, so a key meets a row per task at most (but for repeats within one document).
    """
    w = Window.partitionBy(*(["key"] if by_key else ["d1", "d2"]), F.col("kind") == KNOWN)
    content = F.when(F.col("kind") == OPEN, F.struct("d1", "d2"))
    mixed = (F.coalesce(F.min(content).over(w) != F.max(content).over(w), F.lit(False)) | (F.max("kind").over(w) == MIXED)) if by_key else F.lit(False)
    out = references.withColumns({"least": F.min("id").over(w), "mixed": mixed, "first": F.min(content).over(w) if by_key else F.lit(None)})
    known = F.col("kind") == KNOWN
    repeat = (F.col("kind") == OPEN) & ~F.col("mixed") & F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    told = F.col("mixed") & ~known & ((F.col("kind") == MIXED) | (content == F.col("first")))
    return save(out.where(known | repeat | told).select("id", "row", "pos", "len", (~known & F.col("mixed")).alias("mixed"), "key"))


def with_spans(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows (of keyed) with found, an array of pos << 32 | len of each row's stretches in again (id, row, pos, len)."""
    code = F.shiftleft(F.col("pos"), 32) + F.col("len")
    spans = save(again.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(code).alias("found")))
    few = (spans.agg(F.sum(F.size("found"))).first()[0] or 0) <= BROADCAST_SPANS
    return rows.join(bounded(spans) if few else spans, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("text", "doc_id", "found")
