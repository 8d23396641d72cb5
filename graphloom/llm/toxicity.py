"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import id_schema, mixed, small_batches
from .labelled import MOST_PER_CLASS, class_weights, held_out, sample, sigmoid

#: Bytes of words' beginnings that are terms besides the words; places that terms are hashed to, as bits; factors of each.
PREFIXES, BITS, FACTORS = (4, 5, 6, 7), 18, 6
#: A term's input: how many standard deviations its share of label 1 is off, less the first, and no more than the second.
SHRINK, MOST_INPUT = 2.0, 4.0
IS_WORD = tb.word_table(word_ranges=[(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def terms(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word and every beginning of one, A-Z as a-z."""
    h, s, e = tb.words(raw, starts, IS_WORD, fold=True)
    row = np.searchsorted(starts, s, "right") - 1
    out, rows = [h], [row]
    code = tb._FOLDED
    part = np.zeros(len(s), np.uint64)
    last = len(raw) - 1
    for k in range(max(PREFIXES)):
        part = mixed(part + code[raw[np.minimum(s + k, last)]] if len(raw) else part)
        if k + 1 in PREFIXES:
            long = e - s > k
            out.append(part[long] ^ np.uint64(k + 1))
            rows.append(row[long])
    return np.concatenate(out), np.concatenate(rows)


def present(raw: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs of the terms of some texts, sorted; with wanted, of those places only."""
    h, row = terms(raw, starts)
    place = (h >> np.uint64(64 - BITS)).astype(np.int64)
    if wanted is not None:
        near = np.flatnonzero(wanted[place])
        place, row = place[near], row[near]
    code = np.unique(row << BITS | place)
    return code >> BITS, code & ((1 << BITS) - 1)


def inputs(ones: np.ndarray, n: np.ndarray, rate: float) -> np.ndarray:
    """What a term counts for, if it is in n rows of which `ones` have label 1, while all rows have it at that rate."""
    off = (ones - n * rate) / np.sqrt(np.maximum((n + 1) * rate * (1 - rate), 1e-9))
    return np.sign(off) * np.clip(np.abs(off) - SHRINK, 0, MOST_INPUT)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy()
        for lo, _, raw, starts in tb.chunks(batch.column(0)):
            row, place = present(raw, starts)
            n, ones = np.bincount(place, minlength=1 << BITS), np.bincount(place, label[lo + row], 1 << BITS).astype(np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(ones[at])], names=["place", "n", "ones"])


def _found(stats) -> callable:
    """Rows as (label, places, inputs). A row's own label is left out of what its terms' inputs are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, n, rate = stats.value
        for batch in batches:
            label = batch.column(1).to_numpy()
            for lo, hi, raw, starts in tb.chunks(batch.column(0)):
                row, place = present(raw, starts)
                x = inputs(ones[place] - label[lo + row], n[place] - 1, rate)
                row, place, x = (v[x != 0] for v in (row, place, x))
                cut = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                told = np.zeros(hi - lo, np.uint64)
                np.add.at(told, row, mixed(place.astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), pa.array(told.view(np.int64)), pa.ListArray.from_arrays(cut, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(x.astype(np.float32)))],
                    names=["y", "told", "places", "x"],
                )

    return run


class FactorizationMachine:
    """score = sigmoid(bias + sum of w x over a row's terms + sum of (v_i . v_j) x_i x_j over its pairs of terms)."""

    def __init__(self, x: np.ndarray | None = None, factors: int = FACTORS, seed: int = 7):
        n = 1 << BITS
        self.x = np.zeros(n) if x is None else x
        self.p = {"bias": np.zeros(1), "w": np.full(n, 0.3), "v": np.random.default_rng(seed).normal(0, 0.01, (n, factors))}

    def raw(self, row: np.ndarray, place: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n rows given by their terms: what the score is the sigmoid of, the terms' factors, and the rows' sums of them."""
        v = self.p["v"][place] * x[:, None]
        s = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], 1) if v.shape[1] else np.zeros((n, 0))
        pairs = 0.5 * ((s * s).sum(1) - np.bincount(row, (v * v).sum(1), n))
        return self.p["bias"][0] + np.bincount(row, self.p["w"][place] * x, n) + pairs, v, s

    def fit(self, size: np.ndarray, places: np.ndarray, xs: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1500, batch: int = 256, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> None:
        """size: how many terms each row has; their places and inputs one row after another. Gradient steps scaled by the past ones of each term, with a decay of its weights."""
        if not len(y):
            return
        p = self.p
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        p["bias"][0] = np.log(share / (1 - share))
        past = {"bias": np.full(1, 1e-4), "w": np.full(len(p["w"]), 1e-4), "v": np.full(len(p["w"]), 1e-4)}
        start = np.cumsum(size) - size
        rng = np.random.default_rng(seed)
        for _ in range(-(-steps // -(-len(y) // batch))):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                pick = order[lo : lo + batch]
                row = np.repeat(np.arange(len(pick)), size[pick])
                at = np.arange(len(row)) + np.repeat(start[pick] - (np.cumsum(size[pick]) - size[pick]), size[pick])
                place, x = places[at], xs[at]
                z, v, s = self.raw(row, place, x, len(pick))
                g = weight[pick] * (sigmoid(z) - y[pick]) / len(pick)
                gx = g[row] * x
                some, of = np.unique(place, return_inverse=True)
                dw = np.bincount(of, gx, len(some)) + decay * p["w"][some]
                past["bias"] += g.sum() ** 2
                past["w"][some] += dw**2
                p["bias"] -= rate * g.sum() / np.sqrt(past["bias"])
                p["w"][some] -= rate * dw / np.sqrt(past["w"][some])
                if v.shape[1]:
                    dv = np.stack([np.bincount(of, gx * (s[row, f] - v[:, f]), len(some)) for f in range(v.shape[1])], 1) + decay * p["v"][some]
                    past["v"][some] += (dv**2).sum(1)
                    p["v"][some] -= rate * dv / np.sqrt(past["v"][some])[:, None]

    def score(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row per text; terms whose input is zero add nothing."""
        row, place = present(raw, starts, self.x != 0)
        return sigmoid(self.raw(row, place, self.x[place], len(starts) - 1)[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_CLASS, factors: int = FACTORS) -> FactorizationMachine:
    """Learns from at most about `most` labelled rows per class that aren't held out (see labelled.sample).

    All terms of these rows are hashed to the 2 ** BITS places of the model. A term's input tells how far its rows' share
    of label 1 is from that of all rows, in standard deviations, shrunk towards zero: no count is required, and
    none of them is picked. A row is learnt from with inputs that leave its own label out, so that terms which only it has
    tell nothing. Nulls count as in labelled.sample and score; rows that repeat an id count each; rows of equal terms
    are taken in any order with the same result; very long texts count as a whole, and a term once in each. Without
    labels of both classes all scores are equal. Other columns, whatever their names, are not looked at.
    """
    rows, counts = sample(docs, labels, label, id_col, text_col, most)
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    if not totals.n or totals.ones in (0, totals.n):
        return FactorizationMachine(factors=factors)
    seen = rows.mapInArrow(_count, "place long, n long, ones long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()  # 2 ** BITS rows at most
    n, ones = np.zeros(1 << BITS), np.zeros(1 << BITS)
    place = seen["place"].to_numpy()
    n[place], ones[place] = seen["n"].to_numpy(), seen["ones"].to_numpy()
    rate = totals.ones / totals.n
    stats = docs.sparkSession.sparkContext.broadcast((ones, n, rate))
    # Some rows per class, as Arrow; in an order that doesn't hang on how tasks ended.
    found = rows.mapInArrow(_found(stats), "y int, told long, places array<int>, x array<float>").toArrow().combine_chunks()
    found = found.sort_by([("told", "ascending"), ("y", "ascending")]).combine_chunks()
    model = FactorizationMachine(np.where(n > 0, inputs(ones, n, rate), 0.0), factors)
    y = found["y"].to_numpy().astype(np.float64)
    size = pc.list_value_length(found["places"]).to_numpy().astype(np.int64)
    places, xs = (pc.list_flatten(found[c]).to_numpy() for c in ("places", "x"))
    model.fit(size, places.astype(np.int64), xs.astype(np.float64), y, class_weights(y, counts))
    return model


def _scored(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.score(raw, starts) for _, _, raw, starts in tb.chunks(batch.column(0), tb.SLICE)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score from 0 to 1 of its whole text.

    Null text counts as empty; rows are scored one by one, repeated ones alike, very long ones as a whole; an empty table
    gives none; other columns, whatever their names, are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"))
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), id_schema(rows.schema[1].dataType, "score double"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
