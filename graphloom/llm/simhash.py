"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, id_schema, packed, pieces, save, small_batches, unpacked

#: Words of a shingle; fingerprints link at so many differing bits or fewer.
SHINGLE, DISTANCE = 4, 4
#: Fingerprints of one block key that are compared within one group; larger keys are split by further blocks.
GROUP = 4096
#: Shingles that are hashed before their bits are added up.
HELD = 1 << 16


def _shingles(raw: bytes, n: int) -> Iterator[bytes]:
    """Shingles of n words of raw, space-joined; all words if they are fewer than n, nothing if there are none."""
    tail: list[bytes] = []
    some = False
    for piece in pieces(raw):
        words = tail + piece.split()
        if len(words) < n:
            tail = words
            continue
        some = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        for a, b in zip(starts[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist(), strict=True):
            yield joined[a:b]
        tail = words[len(words) - n + 1 :]
    if not some and tail:
        yield b" ".join(tail)


def fingerprint(raw: bytes, n: int = SHINGLE) -> int:
    """The SimHash of lower-cased raw: bits that more than half of the shingles' hashes have."""
    from xxhash import xxh64_intdigest

    ones, total = np.zeros(64, np.int64), 0
    hashes: list[int] = []

    def add() -> None:
        nonlocal total
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
        hashes.clear()

    for s in _shingles(raw.lower(), n):
        hashes.append(xxh64_intdigest(s, 42))
        if len(hashes) >= HELD:
            add()
    if hashes:
        add()
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little") if total else 0


def _fingerprints(n: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), n) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out.view(np.int64))], names=["doc_id", "row", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (a hash of id and text), fp (the fingerprint as a signed long) for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"))
    return rows.mapInArrow(_fingerprints(shingle), id_schema(rows.schema[0].dataType, "row long, fp long"))


def block_masks(rows: int, distance: int = DISTANCE, within: int = (1 << 64) - 1) -> list[int]:
    """Sets of bits (of `within`) such that two fingerprints at `distance` or nearer agree on one set at least.

    The bits are split into m blocks; at most `distance` blocks differ, so m - distance agree. With more
    blocks keys get longer, so fewer unequal fingerprints meet, but each has more keys. m is the least with
    at most one chance meeting expected for each fingerprint and key.
    """
    bits = [1 << b for b in range(64) if within >> b & 1]
    for m in range(distance + 1, min(len(bits), distance + 5) + 1):
        cuts = [len(bits) * i // m for i in range(m + 1)]
        blocks = [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        if rows <= 1 << (len(bits) * (m - distance) // m):
            break
    return [sum(c) for c in combinations(blocks, m - distance)]


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links among distinct fingerprints that join all which links join: at most one less than there are.

    Each fingerprint not reached yet takes all those near it at once, so nothing is compared twice, and pairs are not listed.
    """
    out = []
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = _near(fps[left], fps[i], distance)
            for j in left[hit].tolist():
                out.append((int(fps[i]), int(fps[j])))
                queue.append(j)
            left = left[~hit]
    return out


def _links(distance: int) -> callable:
    """Rows (mask, key, fp) sorted by mask and key -> verified links."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            cut = new[-1] if len(new) else 0
            if cut:
                yield cols[2][:cut], np.concatenate(([0], new))
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield held[2], np.array([0, len(held[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, at in groups(batches):
            fp, size = fp.view(np.uint64), np.diff(at)
            pair = at[:-1][size == 2]
            pair = pair[_near(fp[pair], fp[pair + 1], distance)]
            a, b = [fp[pair]], [fp[pair + 1]]
            for k in np.flatnonzero(size > 2).tolist():
                if found := forest(fp[at[k] : at[k + 1]], distance):
                    x, y = zip(*found, strict=True)
                    a.append(np.array(x, np.uint64))
                    b.append(np.array(y, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(classes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """classes: distinct fp -> links a, b between fingerprints at `distance` or nearer, enough to join each component.

    Every fingerprint is dealt out under its key for each mask (block_masks), and keys that more than one
    has are compared. Fingerprints of a key that more than `group` have can only differ in the other bits, so those are
    split into blocks in turn, and they are dealt out under longer keys, until groups are small: a hot key is never
    compared as a whole, and no pair is lost. With few bits left a group is small by itself.
    """
    masks = block_masks(classes.count(), distance)
    keyed = _dealt(classes.select("fp"), F.array(*[F.lit(_signed(m)) for m in masks]))
    out = None
    while True:
        sizes = save(keyed.groupBy("mask", "key").count().where("count > 1"))
        shared = keyed.join(bounded(sizes), ["mask", "key"])
        # More bits are left than can be told apart in a small group, or than blocks are needed.
        free = 64 - F.bit_count("mask")
        hot = (F.col("count") > group) & (free > distance + 1)
        small = shared.where(~hot).select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
        found = small.mapInArrow(_links(distance), "a long, b long")
        out = found if out is None else out.unionByName(found)
        large = sizes.where(hot).groupBy("mask").agg(F.max("count").alias("most")).collect()  # some of the masks of this level
        if not large:
            return out.distinct()
        finer = {r.mask: block_masks(r.most, distance, ((1 << 64) - 1) ^ (r.mask & (1 << 64) - 1)) for r in large}
        options = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(m), F.array(*[F.lit(_signed((m & (1 << 64) - 1) | b)) for b in subs]))])
        keyed = save(_dealt(shared.where(hot).select("fp", "mask"), options[F.col("mask")]).distinct())


def _dealt(fps: DataFrame, masks: F.Column) -> DataFrame:
    """fp under each of its masks: mask, key."""
    return fps.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges a, b -> node, root: the least node that can be reached, for every node of an edge.

    Large-star and small-star rounds in turn: each node's larger neighbours, then its smaller ones, are tied to
    the least of its neighbours, until nothing changes. Minima are combined before they are shuffled,
    and a node with many neighbours is only ever joined with one row.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = save(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = save(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    """doc_id, row, fp, component_id for each row of docs."""
    prints = save(fingerprints(docs, id_col, text_col, shingle))
    classes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = save(components(links(classes.select("fp"), distance)))
    named = nodes.join(classes, nodes["node"] == classes["fp"]).select("node", "root", "least")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = save(named.join(roots, "root").select(F.col("node").alias("fp"), "component_id", "root"))
    of_class = save(classes.join(bounded(linked), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return prints.join(bounded(of_class), "fp", "left")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of docs of each group that links join; columns as in docs, other cases as in simhash_dedup.

    The row of the smallest id stays; among rows of that id (or if a group has none) that of the least hash of
    id and text; of rows that repeat both, any one.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")  # rows are told apart by id and hash
    found = save(_grouped(docs, id_col, text_col, shingle, distance).select("doc_id", name, "row", "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "name")).alias("first")
    stays = save(found.groupBy("root").agg(first).select(F.col("first.row").alias("row"), F.col("first.name").alias("name")))
    keys = ["row", "name"]
    goes = save(found.select(*keys).distinct().join(bounded(stays), keys, "left_anti"))
    again = save(found.groupBy(*keys).count().where("count > 1").select(*keys).join(bounded(stays), keys, "left_semi"))
    rows = packed(docs, text_col, id=id_col).withColumns({"row": F.xxhash64("id", "text"), "name": F.coalesce(F.col("id").cast("string"), F.lit(""))}).drop("id", "text")
    rows = rows.join(bounded(goes), keys, "left_anti")
    if again.isEmpty():
        return unpacked(rows)
    once = rows.join(bounded(again), keys, "left_semi").groupBy(*keys).agg(F.first("_row").alias("_row"))
    return unpacked(rows.join(bounded(again), keys, "left_anti").unionByName(once))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the least id that links reach).

    A-Z become lower case; words are what ASCII white space separates; shingles are `shingle` words, repeats
    included, or all words if they are fewer. Without words, or with null text, the fingerprint is zero, and
    it links like any other. Rows with one fingerprint are one class, compared once. A null id is never
    the least unless a component has no other. An empty table gives an empty result; other
    columns, whatever their names, are not looked at. Very long texts are split and hashed some MB at a time.
    """
    out = _grouped(docs, id_col, text_col, shingle, distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
