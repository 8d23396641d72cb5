"""Count-min sketches: a partial one per task, merged by key range, cut down to which cells are full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, save

#: Rows of a sketch; cells of a row that a merging task holds together; most cells of a row.
DEPTH, STRIPE, MOST_CELLS = 2, 1 << 22, 1 << 29
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


def cells_for(df: DataFrame, per_byte: float) -> int:
    """Cells of a row for what df reads: about per_byte for each byte that the plan expects, a power of 2.

    The merged sketch takes DEPTH * cells bits wherever it is sent: MOST_CELLS bounds that to 128 MB. Over more
    input it lets more keys pass that occur once, and never stops one that is repeated.
    """
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected >= 1 << 60:  # not known
        return 1 << 24
    return min(MOST_CELLS, max(1 << 16, 1 << int(np.ceil(np.log2(max(1.0, expected * per_byte))))))


def cell(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mixed(keys ^ _SEEDS[row]) >> np.uint64(64 - int(cells).bit_length() + 1)).astype(np.int64)


class Partial:
    """What a task has counted: per row of the sketch the cells it touched, and those it touched again."""

    def __init__(self, cells: int):
        self.cells, self.held, self.size = cells, [], 0
        self.cap = 1 << 23

    def add(self, keys: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Counts keys; yields what has been counted whenever it gets large."""
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= self.cap:
            yield from self.out()

    def out(self) -> Iterator[tuple[int, int, bytes]]:
        keys = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        self.held, self.size = [], 0
        pack = zstandard.ZstdCompressor(level=1)
        for row in range(DEPTH):
            at = np.sort(cell(keys, row, self.cells))
            again = at[1:][at[1:] == at[:-1]]
            stripes = np.unique(at // STRIPE)
            for s in stripes.tolist():
                once = np.unique(at[np.searchsorted(at, s * STRIPE) : np.searchsorted(at, (s + 1) * STRIPE)])
                twice = np.unique(again[np.searchsorted(again, s * STRIPE) : np.searchsorted(again, (s + 1) * STRIPE)])
                yield row, s, b"".join((len(once).to_bytes(4, "little"), pack.compress(_steps(once)), b"")) + b"|" + pack.compress(_steps(twice))


def _steps(sorted_cells: np.ndarray) -> bytes:
    """Sorted numbers as their differences, in as few bytes each as all of them need."""
    d = np.diff(sorted_cells, prepend=0) if len(sorted_cells) else sorted_cells
    if len(d):
        d[0] %= STRIPE
    kind = "<u2" if len(d) == 0 or d.max() < 1 << 16 else "<u4"
    low = d.astype(kind)
    return kind[2].encode() + low.view(np.uint8).reshape(-1, int(kind[2])).T.tobytes()


def _cells(data: bytes) -> np.ndarray:
    width = int(data[:1])
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return np.cumsum(np.ascontiguousarray(raw).view(f"<u{width}").ravel().astype(np.int64))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums partial sketches; rows come sorted by (row, stripe). Gives one bit per cell: counted twice or more."""
    now, seen, full = None, None, None
    unpack = zstandard.ZstdDecompressor()

    def out() -> pa.RecordBatch:
        bits = pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), bits], names=["row", "stripe", "data"])

    for batch in batches:
        for row, stripe, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if now != (row, stripe):
                if now is not None:
                    yield out()
                now, seen, full = (row, stripe), np.zeros(STRIPE, bool), np.zeros(STRIPE, bool)
            raw = data.as_buffer().to_pybytes()
            read = unpack.decompressobj()
            once = _cells(read.decompress(raw[4:]))
            twice = _cells(unpack.decompressobj().decompress(read.unused_data[1:]))
            full[once] |= seen[once]
            full[twice] = True
            seen[once] = True
    if now is not None:
        yield out()


class Full:
    """The merged sketch, on an executor: whether a key may have been counted twice or more."""

    def __init__(self, cells: int, stripes: dict[tuple[int, int], bytes]):
        self.cells = cells
        self.rows = []
        for row in range(DEPTH):
            bits = np.zeros(max(1, cells // 8), np.uint8)
            for (r, s), data in stripes.items():
                if r == row:
                    part = np.frombuffer(data, np.uint8)[: len(bits)]
                    bits[s * (STRIPE // 8) : s * (STRIPE // 8) + len(part)] = part
            self.rows.append(bits)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row, bits in enumerate(self.rows):
            at = cell(keys, row, self.cells)
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def members(keys: DataFrame):
    """keys (key long, saved) -> a broadcast Full that has all of them, and few others: 16 cells a row for each, up to MOST_CELLS."""
    cells = min(MOST_CELLS, max(1 << 16, 1 << int(keys.count() * 16).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partial(cells)
        for batch in batches:
            yield from partial_rows(part.add(np.repeat(batch.column(0).to_numpy().view(np.uint64), 2)))
        yield from partial_rows(part.out())

    return merged(keys.select("key").mapInArrow(run, "row int, stripe int, data binary"), cells)


def partial_rows(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for row, stripe, data in rows:
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([stripe], pa.int32()), pa.array([data], pa.binary())], names=["row", "stripe", "data"])


def merged(partials: DataFrame, cells: int):
    """partials (row, stripe, data) of all tasks -> a broadcast Full. Its size is bounded by cells."""
    spark = partials.sparkSession
    dealt = partials.repartition("row", "stripe").sortWithinPartitions("row", "stripe")
    full = save(dealt.mapInArrow(_merge, "row int, stripe int, data binary"))
    stripes = {(r.row, r.stripe): bytes(r.data) for r in full.select("row", "stripe", F.col("data")).toLocalIterator()}
    return spark.sparkContext.broadcast(Full(cells, stripes))
