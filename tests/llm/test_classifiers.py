"""Both classifiers: accuracy on rows that were held out, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import tuples

from graphloom.llm import quality, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op2_toxicity, "toxic", 0.9), (quality.op10_quality, "quality", 0.95)])
def test_held_out(spark, query, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = query(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= (0.7 if label == "toxic" else 0.5)) for r in rows)
    own = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in own) / len(own) >= least
    assert tuples(query(spark, BIG), "doc_id", "score") == sorted(((r.doc_id, r.score) for r in rows), key=repr)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd(spark, odd, none, docs, module):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (9, None, 1), (None, 1, 1), (3, 1, 0), (12, 0, 1), (21, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for df in (odd, none):
        model = module.fit(df, labels)
        rows = toxicity.score(df, model).collect()
        assert len(rows) == df.count()
        assert all(0 <= r.score <= 1 for r in rows)
    empty = module.fit(docs, labels.limit(0))
    assert toxicity.score(odd, empty).count() == odd.count()


def test_all_passages(spark):
    """A fit looks at every passage of a document, and thins out whole rows only."""
    text = "".join(f"Passage {i} has words of its own. " * 18 for i in range(100))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "short"]), pa.array([1, 0], pa.int32())], names=["text", "y"])
    want, first = quality.passages(np.frombuffer((text + "short").encode(), np.uint8), np.array([0, len(text), len(text) + 5]))
    got = [np.frombuffer(b["bag"][0].as_py(), np.float32).reshape(-1, quality.N_FEATURES) for b in quality._bags(iter([batch]))]
    assert [len(b) for b in got] == np.diff(first).tolist() and len(got[0]) > 90
    assert (np.concatenate(got) == want.astype(np.float32)).all()
    rows = spark.createDataFrame([(f"{i} " + text, i % 2) for i in range(40)], "text string, y int")
    all_rows = {tuple(r) for r in rows.collect()}
    assert quality.thinned(rows, 10**6).count() == 40
    some = {tuple(r) for r in quality.thinned(rows, 2000).collect()}
    assert some < all_rows and 5 <= len(some) <= 35


def test_toxicity_score_is_the_sum_over_all_terms_and_pairs(spark, odd):
    """By its definition: bias, every term, every pair of terms."""
    rng = np.random.default_rng(1)
    model = toxicity.FactorizationMachine(np.where(rng.random(1 << toxicity.BITS) < 0.3, rng.normal(0, 0.2, 1 << toxicity.BITS), 0))
    model.p["v"] += rng.normal(0, 0.3, model.p["v"].shape)
    for r in toxicity.score(odd.where("doc_id in (5, 7, 22, 30)"), model).collect():
        raw = (next(x.text for x in odd.where(f"doc_id = {r.doc_id}").collect()) or "").encode()
        places = sorted({int(h) >> (64 - toxicity.BITS) for h in toxicity.terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]})
        total = model.p["bias"][0] + sum(model.p["w"][i] * model.x[i] for i in places)
        live = [i for i in places if model.x[i]]
        total += sum(model.p["v"][i] @ model.p["v"][j] * model.x[i] * model.x[j] for k, i in enumerate(live) for j in live[k + 1 :])
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -40, 40))), abs=1e-9)


def test_pairs_matter():
    """Insult and group together are toxic, either alone is not: pairs tell them apart, single terms don't as well."""
    rng = np.random.default_rng(5)
    n, y, texts = 3000, [], []
    for _ in range(n):
        words = [f"w{k}" for k in rng.integers(0, 40, 12)]
        insult, group = (int(k < 0.5) for k in rng.random(2))
        words += ["blockhead"] * insult + ["foreigners"] * group
        y.append(int(insult and group))
        texts.append(" ".join(rng.permutation(words)))
    raw, y = [t.encode() for t in texts], np.array(y, np.float64)
    at = lambda part: (np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts[:2000]), pa.array(y[:2000].astype(np.int32))], names=["text", "y"])
    stats = [np.zeros(1 << toxicity.BITS), np.zeros(1 << toxicity.BITS), float(y[:2000].mean())]
    for b in toxicity._count(iter([batch])):
        stats[1][b["place"].to_numpy()] += b["n"].to_numpy()
        stats[0][b["place"].to_numpy()] += b["ones"].to_numpy()
    wrong = {}
    for factors in (0, toxicity.FACTORS):
        model = toxicity.FactorizationMachine(toxicity.inputs(*stats), factors)
        row, place = toxicity.present(*at(raw[:2000]), model.x != 0)
        model.fit(np.bincount(row, minlength=2000), place, model.x[place], y[:2000], np.ones(2000))
        held = model.score(*at(raw[2000:]))
        wrong[factors] = np.abs(held - y[2000:]).mean()
    assert wrong[toxicity.FACTORS] < 0.05 < wrong[0] and wrong[toxicity.FACTORS] * 2 < wrong[0]


def test_quality_score_is_what_a_loop_over_passages_gives(spark, odd):
    model = quality.AttentionMIL(seed=9)
    model.p["c"] = np.random.default_rng(2).normal(0, 1, quality.HIDDEN)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for r in toxicity.score(odd, model).collect():
        texts = {(x.text or "") for x in odd.collect() if x.doc_id == r.doc_id}
        scores = []
        for text in texts:
            raw = text.encode()
            x, _ = quality.passages(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            h = [np.tanh(np.clip((v - model.mean) / model.scale, -5, 5) @ model.p["W"] + model.p["b"]) for v in x]
            e = np.array([(np.tanh(v @ model.p["A"]) * sigmoid(v @ model.p["B"])) @ model.p["u"] for v in h])
            a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            scores.append(sigmoid(sum(w * v for w, v in zip(a, h)) @ model.p["c"] + model.p["d"][0]))
        assert any(r.score == pytest.approx(s, abs=1e-9) for s in scores)
