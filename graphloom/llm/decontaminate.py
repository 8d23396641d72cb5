"""Benchmark decontamination: an FM-index per training shard, searched for the windows of test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bounded, id_schema, packed, save, small_batches, unpacked

#: Bytes that are part of a word once A-Z are lower case: digits, letters, and all of UTF-8 beyond ASCII.
IS_WORD = tb.word_table(word_ranges=[(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same for Spark's regular expressions, and before the letters become lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a window; bytes of text in a shard; text positions between sampled suffix positions.
WINDOW, SHARD, SAMPLE = 10, 4 << 20, 8
#: Bytes of test items, about, whose windows are searched for in one pass over the documents.
BLOCK_BYTES = 16 << 20


class WaveletMatrix:
    """Ranks in a sequence of small integers: for each bit, from the highest, how many ones precede a position."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair, how often the symbol occurs before the position."""
        at, first = at.astype(np.int64), np.zeros(len(at), np.int64)
        for k, level in enumerate(reversed(range(self.bits))):
            up = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][at], self.ones[k][first]
            at = np.where(up, self.zeros[k] + a, at - a)
            first = np.where(up, self.zeros[k] + b, first - b)
        return at - first


class FMIndex:
    """Over a text of word numbers from 1, in which 0 ends each run of words."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        sa = self.sorted_suffixes(text)
        # No search and no walk goes over a 0, so what precedes a run's first word needs no place of its own.
        bwt = text[sa - 1]
        self.bwt, self.tree = bwt, WaveletMatrix(bwt, max(1, int(size).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size + 1))))
        sampled = (sa % SAMPLE == 0) | (text[sa - 1] == 0) | (sa == 0)
        self.sampled, self.nth, self.at = sampled, np.cumsum(sampled) - 1, sa[sampled]
        self.n = n

    @staticmethod
    def sorted_suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array by doubling; every 0 counts as a symbol of its own, in the order of the text."""
        zero = text == 0
        rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
        span, n = 1, len(text)
        while True:
            after = np.full(n, -1, np.int64)
            after[: n - span] = rank[span:] if span < n else 0
            key = rank * (int(rank.max()) + 2 + n) + after + 1
            sa = np.argsort(key, kind="stable")
            fresh = np.concatenate(([0], np.cumsum(np.diff(key[sa]) != 0)))
            rank = np.empty(n, np.int64)
            rank[sa] = fresh
            if fresh[-1] == n - 1 or span >= n:
                return sa
            span *= 2

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (a row each, of the given lengths): their ranges of suffixes."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(int(length.max(initial=0))):
            live = live[(length[live] > step) & (low[live] < high[live])]
            symbol = phrases[live, length[live] - 1 - step]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a suffix whose position was sampled."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(walk := np.flatnonzero(~self.sampled[rows])):
            symbol = self.bwt[rows[walk]]
            rows[walk] = self.before[symbol] + self.tree.rank(symbol, rows[walk])
            steps[walk] += 1
        return self.at[self.nth[rows]] + steps


class Phrases:
    """The distinct windows of some test items, and their vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            words = _WORDS.findall((text or "").encode().lower())
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                found.setdefault(tuple(words[i : i + n]), set()).add("" if item_id is None else str(item_id))
        vocabulary = sorted({w for p in found for w in p})
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.items = [sorted(v) for v in found.values()]
        self.length = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int32)
        for row, p in zip(self.rows, found, strict=True):
            row[: len(p)] = [number[w] for w in p]
        self.size = len(vocabulary)
        self.bytes = np.frombuffer(b" ".join(vocabulary), np.uint8)
        h, start, end = tb.words(self.bytes, np.zeros(1, np.int64), IS_WORD, fold=True)
        order = np.argsort(h, kind="stable")
        self.hash, self.number = h[order], order + 1
        self.start, self.width = start[order], (end - start)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def numbers(self, raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers in the vocabulary of words of raw, or 0: looked up by hash, compared by their bytes."""
        out = np.zeros(len(h), np.int64)
        word = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.hash, h[word])
        while len(word):  # once, but for words of the vocabulary that share a hash
            there = at < self.size
            word, at = word[there], at[there]
            there = self.hash[at] == h[word]
            word, at = word[there], at[there]
            equal = (end - start)[word] == self.width[at]
            for lo in range(0, len(word), 100_000):
                few = np.flatnonzero(equal[lo : lo + 100_000]) + lo
                size = self.width[at[few]]
                of = np.repeat(np.arange(len(few)), size)
                within = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                unlike = _LOWER[raw[start[word[few]][of] + within]] != self.bytes[self.start[at[few]][of] + within]
                equal[few[of[unlike]]] = False
            out[word[equal]] = self.number[at[equal]]
            word, at = word[~equal], at[~equal] + 1
        return out

    def hits(self, raw: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a shard of words (hash, place, and the number of each one's document): hit phrase, first word, length.

        The index is over all words of the shard; those that no test item has, and ends of documents, are
        marks that no phrase goes over, and several in a row are one.
        """
        number = self.numbers(raw, h, start, end) if len(h) and self.size else np.empty(0, np.int64)
        kept = np.flatnonzero(number)
        if not len(kept):
            none = np.empty(0, np.int64)
            return none, none, none
        ends = np.concatenate((np.flatnonzero((np.diff(kept) > 1) | (np.diff(doc[kept]) != 0)) + 1, [len(kept)]))
        text = np.insert(number[kept], ends, 0)
        word = np.insert(kept, ends, -1)
        index = FMIndex(text, self.size)
        low, high = index.search(self.rows, self.length)
        count = high - low
        phrase = np.repeat(np.arange(len(low)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return phrase, word[index.locate(rows)], self.length[phrase]


def _searched(block, text_at: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for lo, hi, raw, starts in tb.chunks(batch.column(text_at), SHARD):
                h, s, e = tb.words(raw, starts, IS_WORD, fold=True)
                doc = np.searchsorted(starts, s, "right") - 1
                per_doc = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(per_doc) - per_doc
                edge = np.zeros(len(h) + 1, np.int64)
                found: list[set[str]] = [set() for _ in range(hi - lo)]
                phrases: Phrases = block.value
                phrase, at, length = phrases.hits(raw, h, s, e, doc)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                for d, p in np.unique(np.stack((doc[at], phrase)), axis=1).T.tolist() if len(at) else ():
                    found[d].update(phrases.items[p])
                of_doc: list[list[dict]] = [[] for _ in range(hi - lo)]
                if edge.any():
                    # A run never goes over the end of a document: windows don't.
                    hit = np.cumsum(edge[:-1]) > 0
                    cut = np.zeros(len(h), bool)
                    cut[first[per_doc > 0]] = True
                    a = np.flatnonzero(hit & (cut | ~np.concatenate(([False], hit[:-1]))))
                    b = np.flatnonzero(hit & np.concatenate((cut[1:] | ~hit[1:], [True]))) + 1
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        d = int(doc[x])
                        of_doc[d].append({"start": x - int(first[d]), "end": y - int(first[d])})
                n_words += per_doc.tolist()
                spans += of_doc
                items += [sorted(x) for x in found]
            kept = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (word ranges to remove, merged) and items (ids found, as sorted strings).

    A-Z become lower case; words are runs of ASCII letters, digits and characters beyond ASCII. A window is
    `window` consecutive words of an item; an item with fewer words, but not none, is one window. Each task
    takes its rows in shards of some MB (a longer text is a shard of its own) and builds an index of each: suffixes of all
    words sorted, their preceding words in a wavelet matrix, every eighth suffix position sampled. All windows are
    searched in it at once, and the spans of their places are merged.

    Null texts and items without words have no windows; a null item id counts as the empty string; an item that is there
    twice counts once. Rows that repeat an id are looked at one by one. Empty tables give no spans or no rows. Other
    columns of both tables, whatever their names, are not looked at. Items of BLOCK_BYTES at most are broadcast, and
    documents are read once, without a shuffle; more items are dealt into blocks of about that size, with one pass over
    the documents for each, whose hits are merged.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = id_schema(rows.schema["doc_id"].dataType, "n_words long, spans array<struct<start:long,end:long>>, items array<string>")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    if n > 1:
        items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        items = save(items.repartition(n, "block"))

    def phrases(k: int):
        return spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in (items.where(F.col("block") == k) if n > 1 else items).toLocalIterator()], window))

    if n <= 1:
        return rows.mapInArrow(_searched(phrases(0), 1), schema)
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(n), "doc_id").alias("k2")]
    hits = None
    for k in range(n):
        with_key = rows.select(F.struct(*keys).alias("doc_id"), "text")
        part = with_key.mapInArrow(_searched(phrases(k), 1), id_schema(with_key.schema["doc_id"].dataType, "n_words long, spans array<struct<start:long,end:long>>, items array<string>"))
        part = save(part.where(F.size("spans") > 0).select("doc_id.*", "spans", "items"))
        hits = part if hits is None else hits.unionByName(part)
    joined = hits.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = save(joined.select("k1", "k2", _merged_spans(F.col("s")).alias("spans"), "items"))
    out = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), *keys).join(bounded(joined), ["k1", "k2"], "left")
    return out.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(schema[c].dataType)).alias(c) for c in ("spans", "items")])


def _merged_spans(spans: F.Column) -> F.Column:
    """Sorted spans with those that overlap or touch made one."""
    kind = "array<struct<start:long,end:long>>"

    def add(acc: F.Column, s: F.Column) -> F.Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), grown).otherwise(F.concat(acc, F.array(s))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), add)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no window of a test item occurs; columns as in docs, cases as in contamination."""
    found = contamination(packed(docs, text_col), benchmark, id_col="_row")
    return unpacked(found.where(F.size("spans") == 0), "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """For tests: the rows of op3 by looking up every window."""
    table: dict[tuple, set] = {}
    for item_id, text in items:
        w = _WORDS.findall((text or "").encode().lower())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            table.setdefault(tuple(w[i : i + n]), set()).add("" if item_id is None else str(item_id))
    sizes, out = sorted({len(k) for k in table}), []
    for doc_id, text in docs:
        w = _WORDS.findall((text or "").encode().lower())
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := table.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= got
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
