"""Removal of word windows that earlier documents have, behind a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import grams, id_schema, mixed, pieces, runs, save, sliding_min, small_batches
from .sketch import Full, Partial, cells_for, members, merged, partial_rows
from .stretches import References, decided, digests, keyed, reference_schema, with_spans

#: Words of a window, and of the grams of which each window picks one to be counted by.
WINDOW, GRAM = 13, 5
#: Cells of the sketch for each byte that the plan expects to read.
CELLS_PER_BYTE = 0.2


class _Chunk:
    """Windows of some rows' texts: each by the least hash of its grams."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, window: int, gram: int):
        self.hash, start, end = tb.words(raw, starts)
        self.size = end - start
        self.doc = np.searchsorted(starts, start, "right") - 1
        n = len(self.hash) - window + 1
        self.first = np.searchsorted(self.doc, np.arange(len(starts)))
        if n < 1:
            self.at, self.key = np.empty(0, np.int64), np.empty(0, np.uint64)
            self.length = self.at
            return
        least = sliding_min(grams(self.hash, gram, 1), window - gram + 1)
        valid = self.doc[:n] == self.doc[window - 1 :]
        # Neighbouring windows mostly have the same gram: runs of such windows.
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (self.doc[1:n] != self.doc[: n - 1]) | ~valid[:-1]
        at = np.flatnonzero(new & valid)
        left = np.concatenate((np.flatnonzero(new | ~valid), [n]))
        self.at, self.key = at, least[at]
        self.length = left[np.searchsorted(left, at, "right")] - at


def _count(window: int, gram: int, cells: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partial(cells)
        for batch in batches:
            for _, _, raw, starts in tb.chunks(batch.column(0)):
                c = _Chunk(raw, starts, window, gram)
                _, once = np.unique(c.key ^ mixed(c.doc[c.at].astype(np.uint64)), return_index=True)
                yield from partial_rows(part.add(c.key[once]))
        yield from partial_rows(part.out())

    return run


def _contents(c: _Chunk, raw: np.ndarray, starts: np.ndarray, at: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A digest of the n_words words from each of `at` on, one space between."""
    text, cut = raw.tobytes(), starts.tolist()
    plain = b" ".join([b" ".join(words) for a, b in zip(cut, cut[1:], strict=False) if (words := text[a:b].split())])
    end = np.cumsum(c.size + 1) - 1
    return digests([plain[a:b] for a, b in zip((end - c.size)[at].tolist(), end[at + n_words - 1].tolist(), strict=True)])


def _runs(window: int, gram: int, full) -> callable:
    """Runs of windows whose least gram may be repeated, as references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Full = full.value
        held = References(by_key=True)
        for batch in batches:
            rows = batch.column(2).to_numpy()
            for lo, hi, raw, starts in tb.chunks(batch.column(0)):
                c = _Chunk(raw, starts, window, gram)
                keep = np.flatnonzero(sketch.repeated(c.key))
                at, length = c.at[keep], c.length[keep]
                doc = c.doc[at]
                yield from held.add(batch.column(1).slice(lo, hi - lo), rows[lo:hi], doc, c.key[keep], _contents(c, raw, starts, at, length + window - 1), at - c.first[doc], length)
        yield from held.out()

    return run


def _windows(window: int, gram: int, several) -> callable:
    """Single windows whose least gram has several contents, as references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Full = several.value
        held = References(by_key=False)
        for batch in batches:
            rows = batch.column(2).to_numpy()
            for lo, hi, raw, starts in tb.chunks(batch.column(0)):
                c = _Chunk(raw, starts, window, gram)
                keep = np.flatnonzero(sketch.repeated(c.key))
                length = c.length[keep]
                at = np.repeat(c.at[keep], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                doc, one = c.doc[at], np.ones(len(at), np.int64)
                yield from held.add(batch.column(1).slice(lo, hi - lo), rows[lo:hi], doc, np.zeros(len(at), np.uint64), _contents(c, raw, starts, at, one * window), at - c.first[doc], one)
        yield from held.out()

    return run


def _cut(window: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(0), batch.column(2)
            n_words, removed, spans, kept = [], [], [], []
            for i in range(len(texts)):
                raw = texts[i].as_buffer().to_pybytes()
                if not found[i].is_valid:
                    words = [p.split() for p in pieces(raw)]
                    n_words.append(sum(map(len, words)))
                    removed.append(0)
                    spans.append([])
                    kept.append(b" ".join([b" ".join(w) for w in words if w]))
                    continue
                code = np.asarray(found[i].values)
                start, end = code >> 32, (code >> 32) + (code & 0xFFFFFFFF) + window - 1
                words = [w for p in pieces(raw) for w in p.split()]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_words.append(len(words))
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(gone)), strict=True)])
                kept.append(b" ".join(compress(words, (~gone).tolist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"]
            )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cells: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (of removed words) and kept (the rest, one space between).

    A word goes if it is in a window of `window` words that also starts in a row with a smaller id; windows
    are judged on the input. First each task counts, in a count-min sketch, one gram of GRAM words
    per window (that with the least hash, so equal windows pick equal grams) once per row. Partial sketches
    are merged; a window's count is no more than its gram's, and it is looked at further if that may be two or
    more. The sketch never counts too little, so no repeated window is lost. The second pass groups exactly, by 128
    bits of BLAKE2b over the words themselves: first runs of neighbouring windows with one gram, as a whole; then, of the
    grams that have runs with different words, every window. Both are combined within tasks first, so a window
    leaves a task for one id, however common it is there.

    Ids may be of any type that has an order. Null texts have no words. A null id counts as larger than any other;
    rows of one id, null included, don't take words from each other. A row with fewer words than a window keeps them all;
    a very long one is looked at some MB at a time with all of its windows, but is cut as a whole by one task. Rows that
    repeat id and text get equal results. An empty table gives an empty result; other columns, whatever their names, are
    not looked at. The sketch has `cells` cells a row, by default as many as the plan's size asks for, up to a
    bound; past it more windows are grouped, with the same result.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType
    cells = cells or cells_for(docs, CELLS_PER_BYTE)
    full = merged(rows.select("text").mapInArrow(_count(window, GRAM, cells), "row int, stripe int, data binary"), cells)
    found = decided(rows.select("text", "doc_id", "row").mapInArrow(_runs(window, GRAM, full), reference_schema(kind)), by_key=True)
    again = found.where("not mixed")
    several = save(found.where("mixed").select("key").distinct())
    if not several.isEmpty():
        single = rows.select("text", "doc_id", "row").mapInArrow(_windows(window, GRAM, members(several)), reference_schema(kind))
        again = again.unionByName(decided(single, by_key=False))
    out = with_spans(rows, again).mapInArrow(_cut(window), id_schema(kind, "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"))
    return out


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
