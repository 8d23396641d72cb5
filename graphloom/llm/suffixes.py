"""Removal of 50-byte strings that earlier documents have: suffix arrays by two-stage sorting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from . import textbytes as tb
from .common import bounded, id_schema, mixed, runs, save, sliding_min, small_batches
from .sketch import Full, Partial, cells_for, members, merged, partial_rows
from .stretches import References, decided, digests, keyed, ranks, reference_schema, with_spans

#: Bytes of a repeated string, of the grams of which each such string picks one to be dealt by, and of those by which
#: the strings of grams with several contents are looked over again.
LENGTH, GRAM, LONG_GRAM = 50, 16, 40
CELLS_PER_BYTE = 0.4
#: Bytes of text in one suffix array; bytes that one gram's passages may have before they are dealt by whole strings.
ARRAY_BYTES, HOT_BYTES = 4 << 20, 8 << 20
#: Bytes of passages that a task combines at a time; bytes of text that it looks at together, but for longer texts.
HELD_BYTES, CHUNK = 32 << 20, 3 << 20


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all suffixes in order of their first `depth` bytes, how many of those each shares with the one before).

    Two-stage sorting. A suffix is direct if it is smaller than the next one. Only direct suffixes are sorted, by
    their bytes. Every other one is a byte followed by a smaller suffix, so one scan over the buckets in
    ascending order places it: what a bucket holds, in order, tells which suffixes with one byte more
    come next in the buckets of those bytes. Then the common prefixes of neighbours are measured, up to `depth`.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    per = 64 // bits
    symbol = np.concatenate((code[text], np.zeros(depth + 64, np.uint64)))
    # `per` symbols of every suffix in one number, then all numbers that `depth` symbols take.
    word = np.zeros(n + depth, np.uint64)
    for k in range(per):
        word = (word << np.uint64(bits)) | symbol[k : k + n + depth]
    cuts = list(range(0, depth, per))
    short = np.uint64(bits * (cuts[-1] + per - depth))

    def key(at: np.ndarray, k: int) -> np.ndarray:
        w = word[at + cuts[k]]
        return w >> short if k == len(cuts) - 1 else w

    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n), n - 1)[::-1])[::-1]
    direct = step[nearest] > 0

    at = np.flatnonzero(direct)
    at = _in_order(at, key, len(cuts))
    ends = np.searchsorted(text[at], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The empty suffix comes first of all; the last byte is the one before it.
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []

    def tell(found: np.ndarray) -> np.ndarray:
        """Sends what precedes suffixes, in their order, to its buckets."""
        before = found[found > 0] - 1
        before = before[~direct[before]]
        if len(before):
            c = text[before]
            order = np.argsort(c, kind="stable")
            cut = np.flatnonzero(np.diff(c[order])) + 1
            for part in np.split(before[order], cut):
                waiting[text[part[0]]].append(part)
        return found

    for c in used.tolist():
        while waiting[c]:
            now = np.concatenate(waiting[c]) if len(waiting[c]) > 1 else waiting[c][0]
            waiting[c] = []
            out.append(tell(now))  # may send further ones to this very bucket, after these
        out.append(tell(at[ends[c] : ends[c + 1]]))
    sa = np.concatenate(out)
    shared = np.zeros(n, np.int64)
    live = np.arange(1, n)
    for k, c in enumerate(cuts):
        many = min(per, depth - c)
        unlike = key(sa[live], k) ^ key(sa[live - 1], k)
        like = np.full(len(live), many, np.int8)
        for symbols in range(1, many + 1):  # less by one for each symbol from the first unlike one on
            like -= (unlike >> np.uint64(bits * (many - symbols))) != 0
        shared[live] += like
        live = live[unlike == 0]
    return sa, shared


def _in_order(at: np.ndarray, key: Callable[[np.ndarray, int], np.ndarray], many: int) -> np.ndarray:
    """Places in the order of their `many` keys, equal ones ascending; a key is looked at only where those before are equal."""
    if len(at) < 2:
        return at
    first = key(at, 0)
    order = np.argsort(first)
    at, first = at[order], first[order]
    group = np.concatenate(([0], np.cumsum(first[1:] != first[:-1])))
    tied = np.arange(len(at))
    for k in range(1, many + 1):
        # Places of groups of one are where they belong.
        alone = np.bincount(group)[group] == 1
        tied, group = tied[~alone], group[~alone]
        if not len(tied):
            break
        here = at[tied]
        value = key(here, k) if k < many else here
        order = np.argsort(value)
        value = value[order]
        rank = np.empty(len(here), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(value[1:] != value[:-1])))
        both = group << 32 | rank
        order = np.argsort(both)
        at[tied], both = here[order], both[order]
        group = np.concatenate(([0], np.cumsum(both[1:] != both[:-1])))
    return at


def _gram_hashes(part: np.ndarray, gram: int) -> np.ndarray:
    words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
    n = len(part) - gram + 1
    out = np.zeros(n, np.uint64)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[at : at + n])
    return out


class _Chunk:
    """Strings of LENGTH bytes of some rows' texts (with wanted, of those that it marks), in runs that have one gram of least hash."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, gram: int = GRAM, wanted: np.ndarray | None = None, least: np.ndarray | None = None):
        n = len(raw) - LENGTH + 1
        self.n = max(0, n)
        self.at = self.length = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        self.least = least
        if n < 1 or wanted is not None and not wanted.any():
            return
        known = least is not None
        if not known:
            self.least = least = np.empty(n, np.uint64)
        for lo in range(0, n, tb.SLICE):
            hi = min(n, lo + tb.SLICE)
            if not known and (wanted is None or wanted[lo:hi].any()):
                least[lo:hi] = sliding_min(_gram_hashes(np.ascontiguousarray(raw[lo : hi + LENGTH - 1]), gram), LENGTH - gram + 1)
        size = np.diff(starts)
        first = starts[:-1][size >= LENGTH]
        last = starts[1:][size >= LENGTH] - LENGTH + 1  # strings start in [first, last)
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, first, 1)
        np.add.at(edge, last, -1)
        valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
        if wanted is not None:
            valid &= wanted
        # A run ends where the next begins, or at a string that doesn't count.
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        new[first] = True
        at = np.flatnonzero(new & valid)
        left = np.concatenate((np.flatnonzero(new | ~valid), [n]))
        self.at, self.key, self.length = at, least[at], left[np.searchsorted(left, at, "right")] - at

    def strings(self, runs_kept: np.ndarray) -> np.ndarray:
        """For each place, whether a string of these runs starts there."""
        edge = np.zeros(self.n + 1, np.int8)
        edge[self.at[runs_kept]] += 1
        edge[(self.at + self.length)[runs_kept]] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _wanted(raw: np.ndarray, starts: np.ndarray, path: tuple) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The strings whose least gram is known to each sketch of the path, a sequence of (bytes of grams, broadcast sketch).

    And the least hashes of the first one's grams, which are those of all strings.
    """
    wanted = least = None
    for gram, sketch in path:
        c = _Chunk(raw, starts, gram, wanted)
        least = c.least if wanted is None else least
        wanted = c.strings(sketch.value.repeated(c.key))
    return wanted, least


def _count(cells: int, gram: int = GRAM, path: tuple = ()) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partial(cells)
        for batch in batches:
            for _, _, raw, starts in tb.chunks(batch.column(0), CHUNK):
                c = _Chunk(raw, starts, gram, _wanted(raw, starts, path)[0])
                doc = np.searchsorted(starts, c.at, "right") - 1
                _, once = np.unique(c.key ^ mixed(doc.astype(np.uint64)), return_index=True)
                yield from partial_rows(part.add(c.key[once]))
        yield from partial_rows(part.out())

    return run


def _references(full) -> callable:
    """Passages whose gram may be in two rows, as references: without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Full = full.value
        held = References(by_key=True)
        for batch in batches:
            rows = batch.column(2).to_numpy()
            for lo, hi, raw, starts in tb.chunks(batch.column(0), CHUNK):
                c = _Chunk(raw, starts)
                keep = np.flatnonzero(sketch.repeated(c.key))
                at, length = c.at[keep], c.length[keep]
                doc, text = np.searchsorted(starts, at, "right") - 1, raw.tobytes()
                told = digests([text[a:b] for a, b in zip(at.tolist(), (at + length + LENGTH - 1).tolist(), strict=True)])
                yield from held.add(batch.column(1).slice(lo, hi - lo), rows[lo:hi], doc, c.key[keep], told, at - starts[doc], length)
        yield from held.out()

    return run


def _passage_schema(kind: T.DataType) -> T.StructType:
    """Passages with their bytes: open ones, and those known to be repeats, without."""
    return T.StructType([T.StructField("id", kind), *id_schema(kind, "known boolean, key long, row long, pos long, len int, data binary").fields[1:]])


def _batch(known: bool, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    key, ids, row, pos, length, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind), pa.array([known] * len(rows)), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(row, pa.int64()), pa.array(pos, pa.int64()), pa.array(length, pa.int32()), pa.array(data, pa.binary())],
        names=["id", "known", "key", "row", "pos", "len", "data"],
    )


class _Combiner:
    """Passages with the same bytes: that of the smallest id goes on, the others are known to be repeats."""

    def __init__(self, limit: int | None = None):
        self.limit, self.size = HELD_BYTES if limit is None else limit, 0
        self.held: dict[bytes, list[tuple]] = {}
        self.known: list[tuple] = []
        self.kind: pa.DataType | None = None

    def add(self, data: bytes, key: int, i, row: int, pos: int, length: int) -> None:
        new = (key, i, row, pos, length)
        have = self.held.get(data)
        if have is None:
            self.held[data] = [new]
            self.size += len(data) + 200
        elif (first := have[0][1]) == i:
            have.append(new)
        elif i is None or first is not None and i > first:
            self.known.append((*new, None))
        else:
            self.known += [(*x, None) for x in have]
            self.held[data] = [new]

    def out(self, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        if len(self.known) >= 50_000 or all_of_it and self.known:
            yield _batch(True, self.known, self.kind)
            self.known = []
        if self.size >= self.limit or all_of_it:
            rows = [(*x, data) for data, xs in self.held.items() for x in xs]
            self.held, self.size = {}, 0
            for lo in range(0, len(rows), 20_000):
                yield _batch(False, rows[lo : lo + 20_000], self.kind)


def _passages(path: tuple) -> callable:
    """Passages of the strings that the path wants, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Combiner()
        for batch in batches:
            held.kind = batch.column(1).type
            rows = batch.column(2).to_numpy()
            for lo, _, raw, starts in tb.chunks(batch.column(0), CHUNK):
                c = _Chunk(raw, starts, GRAM, *_wanted(raw, starts, path))
                at, length, key = c.at, c.length, c.key.tolist()
                doc = np.searchsorted(starts, at, "right") - 1
                ids = batch.column(1).take(pa.array(lo + doc)).to_pylist()
                text = raw.tobytes()
                for k, a, n, d, i, r in zip(key, at.tolist(), length.tolist(), (at - starts[doc]).tolist(), ids, rows[lo + doc].tolist(), strict=True):
                    held.add(text[a : a + n + LENGTH - 1], k, i, r, d, n)
                yield from held.out(False)
        if held.kind is not None:
            yield from held.out(True)

    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages -> their single strings, dealt by hash; combined within the task."""
    held = _Combiner()
    for batch in batches:
        held.kind = batch.column(0).type
        ids, rows, pos, length = (batch.column(k).to_pylist() for k in (0, 3, 4, 5))
        for k in range(len(batch)):
            data = batch.column(6)[k].as_buffer().to_pybytes()
            for j in range(length[k]):
                s = data[j : j + LENGTH]
                held.add(s, xxh3_64_intdigest(s), ids[k], rows[k], pos[k] + j, 1)
        yield from held.out(False)
    if held.kind is not None:
        yield from held.out(True)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages sorted by key -> those of their strings that a smaller id has, as runs."""
    keys: list[int] = []
    at: list[tuple[int, int]] = []
    data: list[bytes] = []
    held: list = []

    def solve() -> pa.RecordBatch:
        n = len(keys)
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(d, len(number)) for d in data], np.int64)
        ids = pa.array(held, kind)
        rank = ranks(ids)
        least_of = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least_of, of, rank)
        contents = list(number)
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(contents), np.uint8)
        content = np.repeat(np.arange(len(contents)), size)
        offset = np.arange(len(text)) - start[content]
        least = least_of[content]
        sa, shared = suffix_array(text)
        # Neighbours that share LENGTH bytes form groups; those that go over a passage's end don't count.
        group = np.cumsum(shared < LENGTH)
        counts = offset[sa] <= size[content[sa]] - LENGTH
        sa, group = sa[counts], group[counts]
        if len(sa):
            new = np.concatenate(([True], group[1:] != group[:-1]))
            low = np.minimum.reduceat(least_of[content[sa]], np.flatnonzero(new))
            least[sa] = low[np.cumsum(new) - 1]
        # The strings of every passage, one after another: those that a smaller id has, as runs.
        many = size[of] - LENGTH + 1
        first = np.cumsum(many) - many
        mine = np.repeat(np.arange(n), many)
        within = np.arange(int(many.sum())) - first[mine]
        hit = least[start[of][mine] + within] < rank[mine]
        before = np.concatenate(([False], hit[:-1]))
        before[first] = False
        after = np.concatenate((hit[1:], [False]))
        after[first[1:] - 1] = False
        a, b = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
        row, pos = np.array(at, np.int64).T
        return pa.RecordBatch.from_arrays([ids.take(pa.array(mine[a])), pa.array(row[mine[a]]), pa.array(pos[mine[a]] + within[a]), pa.array((b - a).astype(np.int32))], names=["id", "row", "pos", "len"])

    size, kind = 0, None
    for batch in batches:
        kind = batch.column(0).type
        ids, key, row, pos = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
        texts = batch.column(6)
        for k in range(len(batch)):
            if size >= ARRAY_BYTES and key[k] != keys[-1]:
                yield solve()
                keys, at, data, held, size = [], [], [], [], 0
            keys.append(key[k])
            at.append((row[k], pos[k]))
            held.append(ids[k])
            data.append(texts[k].as_buffer().to_pybytes())
            size += len(data[-1])
    if keys:
        yield solve()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, found = batch.column(0), batch.column(2)
        removed, spans, kept = [], [], []
        for i in range(len(texts)):
            raw = texts[i].as_buffer().to_pybytes()
            if not found[i].is_valid:
                removed.append(0)
                spans.append([])
                kept.append(raw)
                continue
            code = np.asarray(found[i].values)
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, code >> 32, 1)
            np.add.at(edge, (code >> 32) + (code & 0xFFFFFFFF) + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(gone)), strict=True)])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        size = np.diff(tb.column_bytes(texts)[1])
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans (of removed bytes) and kept (the rest, binary).

    A byte of the UTF-8 text goes if it is in a string of LENGTH bytes that also starts in a row with a smaller
    id; strings are judged on the input. Every such string picks one gram of GRAM bytes, that of the least hash,
    so equal strings pick equal grams, and neighbouring strings mostly the same: they form a passage.
    A count-min sketch over the tasks tells which grams may be in two rows. Passages of those are dealt twice. At first
    by gram with 128 bits of BLAKE2b in place of their bytes, combined within a task: a gram whose passages are all
    equal is decided by their ids alone. In the others a second sketch, of grams of LONG_GRAM bytes, tells which strings may
    be in two rows; passages of those are dealt with their bytes, equal ones of a task once; each task sorts the suffixes of some MB of different passages at a time (suffix_array), and
    neighbours that share LENGTH bytes are repeats. A gram whose passages have over hot_bytes is taken apart: its passages
    are dealt as single strings, of which a task sends each once.

    Ids may be of any type that has an order. Null texts have no bytes. A null id counts as larger than any other; rows
    of one id, null included, don't take bytes from each other. Very long texts are looked at some MB at a time with all
    of their strings, but are cut as a whole by one task. Rows that repeat id and text get equal results. An empty
    table gives an empty result; other columns, whatever their names, are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    kind, places = rows.schema["doc_id"].dataType, ["id", "row", "pos", "len"]
    cells = cells or cells_for(docs, CELLS_PER_BYTE)
    full = merged(rows.select("text").mapInArrow(_count(cells), "row int, stripe int, data binary"), cells)
    found = decided(rows.select("text", "doc_id", "row").mapInArrow(_references(full), reference_schema(kind)), by_key=True)
    again = found.where("not mixed").select(*places)
    several = save(found.where("mixed").select("key").distinct())
    if not several.isEmpty():
        path = ((GRAM, members(several)),)
        path += ((LONG_GRAM, merged(rows.select("text").mapInArrow(_count(cells, LONG_GRAM, path), "row int, stripe int, data binary"), cells)),)
        passages = save(rows.select("text", "doc_id", "row").mapInArrow(_passages(path), _passage_schema(kind)))
        parts, left = [passages], passages.where("not known")
        hot = save(left.groupBy("key").agg(F.sum(F.length("data")).alias("size")).where(F.col("size") > hot_bytes).select("key"))
        if not hot.isEmpty():
            strings = save(left.join(bounded(hot), "key", "left_semi").select(*passages.columns).mapInArrow(_strings, _passage_schema(kind)))
            left = left.join(bounded(hot), "key", "left_anti").select(*passages.columns).unionByName(strings.where("not known"))
            parts.append(strings)
        solved = left.repartition("key").sortWithinPartitions("key").mapInArrow(_repeats, T.StructType([passages.schema[c] for c in places]))
        for part in [solved, *[p.where("known").select(*places) for p in parts]]:
            again = again.unionByName(part)
    return with_spans(rows, again).mapInArrow(_cut, id_schema(kind, "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
