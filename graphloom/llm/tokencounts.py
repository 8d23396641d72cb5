"""Token counts of documents that are edited: segment trees over pre-tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import id_schema, save, small_batches

#: Pre-tokens in a leaf at first, and the most before a tree is built anew.
LEAF, MOST_LEAF = 32, 512
#: Characters that are split into pre-tokens at a time; between two of them a blank stands between others.
PIECE = 1 << 20
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


class Counts(dict):
    """pre-token -> its count of tokens; forgets all beyond a million."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.pattern = ranks, regex.compile(pattern)

    def __missing__(self, token: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        n = 1 if token.encode() in self.ranks else len(self.encoding.encode_ordinary(token))
        if len(token) <= 100:
            self[token] = n
        return n

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@lru_cache(2)
def counts(path: str, pattern: str) -> Counts:
    return Counts(path, pattern)


class TokenTree:
    """A document as leaves of some pre-tokens each, and a tree of sums of their characters, tokens and pre-tokens.

    A pre-token starts wherever the one before ends, and what it is depends on the text from there on. So after an edit
    the pre-tokens are as before up to two before the edit, and again from where a new one and an old one start
    at the same place. An edit splits and counts just the leaves from one before it up to such a place.
    """

    def __init__(self, leaves: list[str], n_tokens: np.ndarray, n_pretokens: np.ndarray, known: Counts):
        self.known, self.recounted = known, 0
        self._build(list(leaves) or [""], n_tokens if len(leaves) else np.zeros(1, np.int64), n_pretokens if len(leaves) else np.zeros(1, np.int64))

    def _build(self, leaves: list[str], n_tokens: np.ndarray, n_pretokens: np.ndarray) -> None:
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), np.int64)  # characters, tokens, pre-tokens
        mine = slice(self.size, self.size + len(leaves))
        self.sums[mine, 0] = np.fromiter(map(len, leaves), np.int64, len(leaves))
        self.sums[mine, 1], self.sums[mine, 2] = n_tokens, n_pretokens
        width = self.size
        while width > 1:
            self.sums[width // 2 : width] = self.sums[width : 2 * width : 2] + self.sums[width + 1 : 2 * width : 2]
            width //= 2

    @classmethod
    def of(cls, text: str, known: Counts) -> TokenTree:
        """The tree of a text, all of which is counted."""
        leaves: list[str] = []
        sums: list[np.ndarray] = []
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE and (cut := _SAFE.search(text, at + PIECE)):
                end = cut.start()
            tokens = known.split(text[at:end])
            own, n = _leaves(tokens, known)
            leaves += own
            sums.append(n)
            at = max(end, at + 1)
        n = np.concatenate(sums) if sums else np.empty((0, 2), np.int64)
        return cls(leaves, n[:, 0], n[:, 1], known)

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_pretokens(self) -> int:
        return int(self.sums[1, 2])

    def parts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What a kept tree consists of: the leaves, and the tokens and pre-tokens of each. The other sums follow from them."""
        own = self.sums[self.size : self.size + len(self.leaves)]
        return self.leaves, own[:, 1], own[:, 2]

    def find(self, char: int) -> tuple[int, int]:
        """(leaf, its first character's place) of a character; the last leaf for those beyond the end."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if char - before >= left and (char < self.n_chars or self.first_leaf(node + 1) < len(self.leaves)):
                before += left
                node += 1
        return node - self.size, before

    def first_leaf(self, node: int) -> int:
        while node < self.size:
            node *= 2
        return node - self.size

    def _set(self, leaf: int, text: str, tokens: int, pretokens: int) -> None:
        self.leaves[leaf] = text
        node = self.size + leaf
        self.sums[node] = len(text), tokens, pretokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _back(self, leaf: int, chars: int) -> tuple[int, int]:
        """The nearest leaf before this one that has text, and the characters between."""
        leaf -= 1
        while leaf > 0 and not self.leaves[leaf]:
            leaf -= 1
        return max(0, leaf), len(self.leaves[leaf]) if leaf >= 0 else 0

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replaces `delete` characters from `pos` on; both are cut down to the text."""
        pos = min(max(0, pos), self.n_chars)
        delete = min(max(0, delete), self.n_chars - pos)
        low, start = self.find(max(0, pos - 1))
        for _ in range(2):  # two pre-tokens of context at least
            if low > 0:
                low, n = self._back(low, start)
                start -= n
        high, _ = self.find(pos + delete)
        last = len(self.leaves) - 1
        while True:
            text = "".join(self.leaves[low : high + 1])
            new = text[: pos - start] + insert + text[pos - start + delete :]
            ahead, after = high + 1, ""
            while ahead <= last and not after:
                after, ahead = self.leaves[ahead], ahead + 1
            tokens = self.known.split(new + after)
            place = np.concatenate(([0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))))
            k = int(np.searchsorted(place, len(new)))
            if place[k] == len(new):
                break
            high = ahead - 1  # the pre-tokens don't meet yet
        self.recounted += k
        slots = high - low + 1
        if k > MOST_LEAF * slots:  # split the leaves; the others' counts stay
            own, n = _leaves(tokens[:k], self.known)
            old = self.sums[self.size : self.size + len(self.leaves), 1:]
            sums = np.concatenate((old[:low], n, old[high + 1 :]))
            self._build([*self.leaves[:low], *own, *self.leaves[high + 1 :]], sums[:, 0], sums[:, 1])
            return
        n = np.fromiter(map(self.known.__getitem__, tokens[:k]), np.int64, k)
        cuts = [k * i // slots for i in range(slots + 1)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            self._set(low + i, new[place[a] : place[b]], int(n[a:b].sum()), b - a)

    def text(self) -> str:
        return "".join(self.leaves)


def _leaves(tokens: list[str], known: Counts) -> tuple[list[str], np.ndarray]:
    """Pre-tokens as leaves of LEAF each, with the tokens and pre-tokens of each."""
    if not tokens:
        return [""], np.zeros((1, 2), np.int64)
    first = np.arange(0, len(tokens), LEAF)
    n = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    own = ["".join(tokens[a : a + LEAF]) for a in first.tolist()]
    return own, np.stack((np.add.reduceat(n, first), np.diff(np.append(first, len(tokens)))), 1)


#: Columns of kept trees besides doc_id.
TREE = "n_tokens long, n_pretokens long, n_chars long, leaves array<string>, leaf_tokens array<int>, leaf_pretokens array<int>"
EDITS = "array<struct<pos:long,n_delete:long,insert:string>>"


class _Trees:
    """Trees, and numbers besides, on their way into batches of some MB."""

    def __init__(self, more: tuple[str, ...] = ()):
        self.more = more
        self.clear()

    def clear(self) -> None:
        self.ids: list[pa.Array] = []
        self.rows: list[tuple] = []
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, doc_id: pa.Array, tree: TokenTree, *more: int) -> Iterator[pa.RecordBatch]:
        self.ids.append(doc_id)
        self.rows.append((tree.n_tokens, tree.n_pretokens, tree.n_chars, *more))
        self.parts.append(tree.parts())
        self.size += tree.n_chars
        if self.size >= tb.CHUNK:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        numbers = list(zip(*self.rows, strict=True))
        at = pa.array(np.concatenate(([0], np.cumsum([len(p[0]) for p in self.parts]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array([x for p in self.parts for x in p[0]], pa.string()))]
        lists += [pa.ListArray.from_arrays(at, pa.array(np.concatenate([p[k] for p in self.parts]).astype(np.int32))) for k in (1, 2)]
        arrays = [pa.concat_arrays(self.ids), *[pa.array(c, pa.int64()) for c in numbers[:3]], *lists, *[pa.array(c, pa.int64()) for c in numbers[3:]]]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_pretokens", "n_chars", "leaves", "leaf_tokens", "leaf_pretokens", *self.more])
        self.clear()


def _built(path: str, pattern: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = counts(path, pattern), _Trees()
        for batch in batches:
            for lo, hi, raw, starts in tb.chunks(batch.column(0)):
                text = raw.tobytes()
                for i in range(lo, hi):
                    yield from out.add(batch.column(1).slice(i, 1), TokenTree.of(text[starts[i - lo] : starts[i - lo + 1]].decode(), known))
        yield from out.out()

    return run


def token_trees(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tree per row of docs, to be kept as a table: doc_id, n_tokens, n_pretokens, n_chars, and its leaves (texts, tokens, pre-tokens).

    ranks is a file of byte-level BPE ranks, pattern splits text into pre-tokens; a text's tokens are those of its
    pre-tokens. Null texts count as empty, and an empty text is one empty leaf. Very long texts are split some MB at a
    time. Rows are independent: repeated ids don't matter. An empty table gives an empty result; other columns, whatever
    their names, are not looked at. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    return rows.mapInArrow(_built(ranks, pattern), id_schema(rows.schema[1].dataType, TREE))


def _edited(path: str, pattern: str, keep: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = counts(path, pattern), _Trees(("n_recounted",))
        for batch in batches:
            done: list[tuple] = []
            for i in range(len(batch)):
                leaves, tokens, pretokens = (batch.column(k)[i] for k in (1, 2, 3))
                edits = [e for e in batch.column(4)[i].as_py() or () if e is not None]
                tree = TokenTree(leaves.as_py(), np.asarray(tokens.values, np.int64), np.asarray(pretokens.values, np.int64), known)
                for e in edits:
                    tree.edit(e["pos"] or 0, e["n_delete"] or 0, e["insert"] or "")
                if keep:
                    yield from out.add(batch.column(0).slice(i, 1), tree, tree.recounted)
                else:
                    done.append((tree.n_tokens, tree.n_chars, tree.recounted))
            if done:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*done, strict=True)]], names=["row", "n_tokens_edited", "n_chars_edited", "n_recounted"])
        yield from out.out()

    return run


def edited_trees(trees: DataFrame, edits: F.Column, ranks: str, pattern: str) -> DataFrame:
    """Kept trees after their edits, with n_recounted, the pre-tokens that were encoded for that.

    edits is an array of (pos, n_delete, insert), applied in turn, in characters of the text as it is by then; places
    beyond the text count as its end; null edits, and null parts of one, as none. Trees without edits don't go to Python. Of
    the others only the touched leaves and their neighbours are split and encoded again.
    """
    small_batches(trees.sparkSession)
    names = trees.columns
    rows = trees.withColumn("_edits", edits.cast(EDITS))
    some = F.coalesce(F.size("_edits") > 0, F.lit(False))
    new = rows.where(some).select("doc_id", "leaves", "leaf_tokens", "leaf_pretokens", "_edits").mapInArrow(_edited(ranks, pattern, True), id_schema(trees.schema["doc_id"].dataType, TREE + ", n_recounted long"))
    return new.unionByName(rows.where(~some).select(*names, F.lit(0).cast("long").alias("n_recounted")))


def counts_after(trees: DataFrame, edits: F.Column, ranks: str, pattern: str) -> DataFrame:
    """The counts alone: doc_id, n_tokens, n_pretokens, and n_tokens_edited, n_chars_edited, n_recounted; cases as in edited_trees."""
    small_batches(trees.sparkSession)
    before = F.struct("doc_id", "n_tokens", "n_pretokens").alias("row")
    rows = trees.select(before, "leaves", "leaf_tokens", "leaf_pretokens", edits.cast(EDITS).alias("edits"))
    out = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_tokens_edited long, n_chars_edited long, n_recounted long").fields])
    return rows.mapInArrow(_edited(ranks, pattern, False), out).select("row.*", "n_tokens_edited", "n_chars_edited", "n_recounted")


def sample_edits(id_col: str = "doc_id", chars_col: str = "n_chars") -> F.Column:
    """Three edits that hang on a row's id and length: an insertion, a deletion and a replacement."""
    n = F.col(chars_col)
    seed = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    edit = lambda pos, gone, new: F.struct(pos.cast("long").alias("pos"), F.lit(gone).cast("long").alias("n_delete"), F.lit(new).alias("insert"))
    return F.array(edit(seed % (n + 1), 0, " newly added, words"), edit(F.floor(n / 2), 9, ""), edit(F.floor(seed / 7) % (n + 1), 4, "Xy  "))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text once into trees that are kept as a table, and counts again after three edits of each from those trees."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = save(token_trees(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, pattern))
    return counts_after(trees, sample_edits(), ranks, pattern)
