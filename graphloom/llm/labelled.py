"""What the two classifiers share: the held-out rule, a bounded sample of labelled rows, Adam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches

#: Labelled rows of each class that a fit takes at most, about.
MOST_PER_CLASS = 6000


def held_out(doc_id) -> F.Column:
    """Whether a row is never learnt from: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """A saved table (text, y) of about `most` rows per class at most, and how many rows each class has.

    Rows are picked by a hash of their ids, from labelled rows that aren't held out; ids with contrary or
    null labels are left out. The picked ids are few by construction, so they are broadcast.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    known = save(known)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.element_at(F.create_map(*[x for y in (0, 1) for x in (F.lit(y), F.lit(min(1.0, most / max(1, counts.get(y, 0)))))]), F.col("y"))
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * float(1 << 30))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return save(rows.join(F.broadcast(picked), "id").select("text", "y").repartition(16)), counts


def labels_of(df: DataFrame) -> np.ndarray:
    return np.array([r.y for r in df.select("y").collect()], np.float64)


class Adam:
    """Steps for a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.params[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.params[k] -= self.rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample the classes' shares among all labelled rows."""
    total = sum(counts.values())
    w = np.ones(len(y))
    for k in (0, 1):
        n = (y == k).sum()
        if n:
            w[y == k] = counts.get(k, 0) / total * len(y) / n
    return w
