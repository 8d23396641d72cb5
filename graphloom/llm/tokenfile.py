"""Token-id output: documents as token ids in shards of patched frame-of-reference blocks."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bounded, mixed, runs, save, scratch, small_batches

#: First bytes of a shard; ids in a block; bytes of text in a shard, but for longer documents.
MAGIC, BLOCK, SHARD_BYTES = b"GLTK0001", 1024, 4 << 20
#: Share of a block's ids that must fit its width; those beyond are exceptions.
PERCENTILES = (0.85, 0.95, 1.0)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """A row of BLOCK integers below 2 ** width per block -> its bytes, lowest bit first."""
    if not width:
        return np.empty((len(values), 0), np.uint8)
    bits = np.empty((*values.shape, width), np.uint8)
    for k in range(width):
        bits[:, :, k] = (values >> np.uint32(k)) & np.uint32(1)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), BLOCK), np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    out = np.zeros((len(packed), BLOCK), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_shard(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a shard.

    MAGIC; counts of ids, documents and blocks (uint64); the documents' lengths (uint32); then for each block
    its start in the body (uint64), minimum (uint32), width and count of exceptions (uint16); then the body. A
    block's body: its ids less the minimum, the low `width` bits of each; then the exceptions' places
    (uint16) and their other bits (uint32). A block is as wide as one of PERCENTILES of its ids asks,
    whichever takes the fewest bytes. The last block is filled up with its minimum.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    rows = np.empty(blocks * BLOCK, np.uint32)
    rows[:n] = ids
    if n % BLOCK:
        rows[n:] = rows[(blocks - 1) * BLOCK : n].min()
    rows = rows.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    rows = rows - low[:, None]
    need = np.zeros(rows.shape, np.uint8)
    for k in range(32):
        over = rows >= np.uint32(1 << k)
        if not over.any():
            break
        need += over
    order = np.sort(need, axis=1) if blocks else need
    widths = np.stack([order[:, int(np.ceil(p * BLOCK)) - 1] for p in PERCENTILES], 1).astype(np.int64) if blocks else np.empty((0, 3), np.int64)
    outliers = np.stack([(need > widths[:, [k]]).sum(axis=1) for k in range(len(PERCENTILES))], 1)
    cost = widths * (BLOCK // 8) + outliers * 6
    pick = cost.argmin(axis=1) if blocks else np.empty(0, np.int64)
    width, extra = widths[np.arange(blocks), pick], outliers[np.arange(blocks), pick]
    size = width * (BLOCK // 8) + extra * 6
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        packed = pack_bits(rows[at] & np.uint32((1 << w) - 1), w)
        body[start[at][:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(need > width[:, None])
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    after = start[block] + width[block] * (BLOCK // 8)
    body[(after + nth * 2)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    high = (rows[block, place] >> width[block].astype(np.uint32)).astype("<u4")
    body[(after + extra[block] * 2 + nth * 4)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    index = np.zeros(blocks, [("start", "<u8"), ("low", "<u4"), ("width", "<u2"), ("extra", "<u2")])
    index["start"], index["low"], index["width"], index["extra"] = start, low, width, extra
    return b"".join((MAGIC, struct.pack("<QQQ", n, len(lengths), blocks), lengths.astype("<u4").tobytes(), index.tobytes(), body.tobytes()))


def shard_index(data: bytes) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Count of ids, documents' lengths, index of blocks, and where the body starts."""
    if data[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    n, docs, blocks = struct.unpack_from("<QQQ", data, 8)
    lengths = np.frombuffer(data, "<u4", docs, 32)
    index = np.frombuffer(data, [("start", "<u8"), ("low", "<u4"), ("width", "<u2"), ("extra", "<u2")], blocks, 32 + 4 * docs)
    return n, lengths, index, 32 + 4 * docs + 16 * blocks


def decode_shard(data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, documents' lengths) of a shard; with first and last only those blocks are read."""
    n, lengths, index, at = shard_index(data)
    index = index[first:last]
    body = np.frombuffer(data, np.uint8, offset=at)
    start, width, extra = (index[k].astype(np.int64) for k in ("start", "width", "extra"))
    rows = np.empty((len(index), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        pick = np.flatnonzero(width == w)
        rows[pick] = unpack_bits(body[start[pick][:, None] + np.arange(w * (BLOCK // 8))], w)
    block = np.repeat(np.arange(len(index)), extra)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    after = start[block] + width[block] * (BLOCK // 8)
    place = np.ascontiguousarray(body[(after + nth * 2)[:, None] + np.arange(2)]).view("<u2").ravel().astype(np.int64)
    high = np.ascontiguousarray(body[(after + extra[block] * 2 + nth * 4)[:, None] + np.arange(4)]).view("<u4").ravel()
    rows[block, place] |= high << width[block].astype(np.uint32)
    rows += index["low"][:, None]
    return rows.ravel()[: max(0, n - first * BLOCK)], lengths


#: Marks that are a pre-token of their own where letters, digits or white space of ASCII stand on both sides.
_MARKS = b".,!?:;%#$&*|"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 3, np.uint8)
_KIND[list(b" \t\n\v\f\r0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 0
_KIND[list(_MARKS)] = 1


#: The normalizer and the splitting pattern with which a text's ids are those of its stretches.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def by_stretches(config: str) -> bool:
    """Whether a tokenizer (its JSON) lower-cases, drops white space, splits as _SPLIT does, and has special tokens with "<|" only."""
    t = json.loads(config)
    steps = (t["pre_tokenizer"] or {}).get("pretokenizers", [])
    bytes_only = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    plain = lambda a: "<|" in a["content"] and not any(a[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(map(str.isspace, a["content"]))
    return (t["normalizer"] or {}).get("normalizers") == _NORMALIZERS and bytes_only and steps[0] == _SPLIT and all(map(plain, t["added_tokens"])) and t["model"]["type"] == "BPE" and not t["model"].get("dropout")


class WholeIds:
    """Token ids of whole texts, by the library alone: for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, raw: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each text) of texts that lie one after another in raw, each with end_id appended."""
        text, cut = raw.tobytes(), starts.tolist()
        ids = [[*self.tokenizer.encode(text[a:b].decode(), add_special_tokens=False).ids, end_id] for a, b in zip(cut, cut[1:], strict=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts


class WordIds:
    """Token ids of stretches of text: a table sorted by the stretches' hashes, and the library for new ones.

    Only for tokenizers that by_stretches knows: they lower-case, drop white space, and take letters, digits and runs
    of other signs apart before they merge. A text's ids are then those of its stretches, and most of them occur again and
    again. New ones are encoded together, a space between; each token's offset tells whose it is.
    """

    #: Stretches beyond which all are forgotten; stretches encoded together; bytes of one that is told apart by place.
    MOST, TOGETHER, LONG = 2_000_000, 4096, 64

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.n, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, count of each). Of words of ASCII letters, one pre-token each, just the case and the merges are left to do."""
        merge = self.tokenizer.model.tokenize
        plain = [w.isalpha() for w in words]
        ids: list = [[t.id for t in merge(w.lower().decode())] if p else None for w, p in zip(words, plain, strict=True)]
        rest = [i for i, p in enumerate(plain) if not p]
        for lo in range(0, len(rest), self.TOGETHER):
            some = rest[lo : lo + self.TOGETHER]
            texts = [words[i].decode() for i in some]
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            first = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            cut = np.searchsorted(np.searchsorted(ends, first, "right"), np.arange(len(some) + 1)).tolist()
            all_ids = found.ids
            for i, x, y in zip(some, cut, cut[1:], strict=False):
                ids[i] = all_ids[x:y]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def encode(self, raw: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each text) of texts that lie one after another in raw, each with end_id appended.

        The stretches that differ are looked up once, and numpy puts the ids of all in place. They are told
        apart by 64 bits of hash.
        """
        # The tokenizer lower-cases; only its special tokens' names, which have a "<|", are told apart by case.
        low = _LOWER[raw]
        for at in np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)).tolist() if len(raw) else ():
            k = int(np.searchsorted(starts, at, "right"))
            low[starts[k - 1] : starts[k]] = raw[starts[k - 1] : starts[k]]
        kind = np.concatenate((np.zeros(1, np.uint8), _KIND[raw], np.zeros(1, np.uint8)))
        a, b = runs(kind == 1)
        apart = (kind[a - 1] == 0) & (kind[b] == 0)
        cuts = np.union1d(starts, np.concatenate((a[apart] - 1, b[apart] - 1)))
        h, s, e = tb.words(low, cuts)
        doc = np.searchsorted(starts, s, "right") - 1
        long = e - s > self.LONG
        h[long] = mixed(s[long].astype(np.uint64))
        u, first, of = np.unique(h, return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.hash, u), max(0, len(self.hash) - 1))
        known = self.hash[near] == u if len(self.hash) else np.zeros(len(u), bool)
        known &= ~long[first]
        new = np.flatnonzero(~known)
        text = low.tobytes()
        ids, counts = self.learn([text[x:y] for x, y in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
        flat = np.concatenate((self.flat, ids))
        at, each = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
        at[known], each[known] = self.at[near[known]], self.n[near[known]]
        at[new], each[new] = len(self.flat) + np.cumsum(counts) - counts, counts
        keep = new[~long[first[new]]]
        order = np.argsort(np.concatenate((self.hash, u[keep])), kind="stable")
        self.hash, self.at, self.n = (np.concatenate(x)[order] for x in ((self.hash, u[keep]), (self.at, at[keep]), (self.n, each[keep])))
        self.flat = flat
        if len(self.hash) > self.MOST or len(flat) > 8 * self.MOST:
            self.forget()
        n = each[of]
        lengths = np.bincount(doc, n, len(starts) - 1).astype(np.int64) + 1
        out = np.full(int(lengths.sum()), end_id, np.uint32)
        place = np.arange(int(n.sum()))
        out[place + np.repeat(doc, n)] = flat[place + np.repeat(at[of] - (np.cumsum(n) - n), n)]
        return out, lengths


@lru_cache(2)
def encoder(path: str) -> WordIds | WholeIds:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return WordIds(tokenizer) if by_stretches(tokenizer.to_str()) else WholeIds(tokenizer)


def _shards(path: str, end_id: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        words = encoder(path)
        for batch in batches:
            for lo, hi, raw, starts in tb.chunks(batch.column(1), SHARD_BYTES):
                ids, lengths = words.encode(raw, starts, end_id)
                names = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before]), pa.array([len(ids)]), names, pa.array([encode_shard(ids, lengths)], pa.binary())], names=["part", "before", "n_ids", "docs", "data"])
                before += len(ids)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of docs to the folder `path`, in ascending id order, null ids first.

    Rows are dealt by ranges of (id, hash of the text), so that many rows of one id don't meet in a task, and
    sorted within each; rows that repeat an id follow each other in order of that hash. A task writes its rows as
    shards of about SHARD_BYTES of text, one after another; a document never spans two shards. Each shard is one
    binary value (see encode_shard) in a row with its part, the ids before it there, its count of ids and its
    documents' ids: Spark's Parquet writer commits or drops a task's rows as a whole, on any file system that Spark
    knows. Null text counts as empty: such a document is just the end id. An empty table gives a folder without shards.
    Very long texts are shards of their own. Other columns, whatever their names, are not written. `tokenizer` is
    a JSON file of the tokenizers library: one that by_stretches knows takes the short way of WordIds, any other is
    asked for whole texts. Special tokens' names in a text become their ids, as the library has it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = dealt.mapInArrow(_shards(tokenizer, end_id), f"part int, before long, n_ids long, docs array<{kind}>, data binary")
    out.write.option("parquet.block.size", 8 << 20).parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            ids, lengths = decode_shard(batch.column(3)[r].as_buffer().to_pybytes())
            names = batch.column(2).slice(r, 1).flatten()
            end = np.cumsum(lengths, dtype=np.int64)
            raw, start = memoryview(ids.astype("<u4").tobytes()), end - lengths
            crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            part = pa.array([batch.column(0)[r].as_py()] * len(names), pa.int32())
            yield pa.RecordBatch.from_arrays([names, part, pa.array(start + batch.column(1)[r].as_py()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of such a folder: doc_id, start, n_tokens, ids_crc32 (of its ids as uint32, little-endian).

    A shard's place in its part is in its row; the parts' places come from their counts, and there are no
    more parts than the writer had tasks.
    """
    shards = spark.read.parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = save(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")))
    kind = shards.schema["docs"].dataType.elementType.simpleString()
    rows = shards.select("part", "before", "docs", "data").mapInArrow(_read, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long")
    return rows.join(bounded(parts), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs' token files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{scratch(spark)}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
