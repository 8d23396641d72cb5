"""50-byte strings against a dictionary of all of them, and suffix arrays against sorting."""

import hashlib
import os

import numpy as np
import pytest
from conftest_llm import SF, tuples

from graphloom.llm import stretches, suffixes

N = suffixes.LENGTH


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        for k in range(len(b) - N + 1):
            s = b[k : k + N]
            least[s] = min(least.get(s, 1 << 63), 1 << 63 if i is None else i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - N + 1):
            if least[b[k : k + N]] < (1 << 63 if i is None else i):
                gone[k : k + N] = b"\1" * N
        spans = bytes(gone).split(b"\0")
        out.append((i, len(b), sum(gone), len([s for s in spans if s]), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [suffixes.HOT_BYTES, 200])
@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_suffixes(request, which, hot, monkeypatch):
    df = request.getfixturevalue(which)
    if hot == 200:
        monkeypatch.setattr(stretches, "BROADCAST_SPANS", -1)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert digest(suffixes.suffix_dedup(df, hot_bytes=hot)) == brute(rows)


def test_query(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert tuples(suffixes.op5_suffix_dedup(spark, SF), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute(rows)


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, size in ((1, 1), (7, 1), (200, 1), (300, 2), (500, 4), (3000, 200)):
        text = rng.integers(0, size, n).astype(np.uint8)
        raw = text.tobytes()
        sa, shared = suffixes.suffix_array(text, 20)
        assert sorted(sa.tolist()) == list(range(n))
        heads = [raw[i : i + 20] for i in sa]
        assert heads == sorted(heads)
        assert shared.tolist() == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(heads, heads[1:])]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_later_keys_are_read_where_earlier_ones_are_equal(n):
    rng, read = np.random.default_rng(n), []
    keys = [rng.integers(0, top, 2000, dtype=np.uint64) for top in (1 << 40, 3, 2)]
    keys[0][::2] %= np.uint64(40)
    at = np.sort(rng.choice(2000, n, replace=False))

    def key(places, k):
        read.append((k, len(places)))
        return keys[k][places]

    assert np.array_equal(suffixes._in_order(at, key, 3), at[np.lexsort([k[at] for k in reversed(keys)])])
    assert all(many <= (keys[0][at] < 40).sum() for k, many in read if k)


def test_least_grams_of_a_chunk_are_hashed_once(monkeypatch):
    seen, hashes = [], suffixes._gram_hashes
    monkeypatch.setattr(suffixes, "_gram_hashes", lambda part, gram: seen.append(gram) or hashes(part, gram))
    raw, starts = np.random.default_rng(1).integers(97, 123, 500, dtype=np.uint8), np.array([0, 200, 500])
    every = type("Sketch", (), {"repeated": staticmethod(lambda keys: np.ones(len(keys), bool))})
    path = tuple((g, type("Sent", (), {"value": every})) for g in (suffixes.GRAM, suffixes.LONG_GRAM))
    c = suffixes._Chunk(raw, starts, suffixes.GRAM, *suffixes._wanted(raw, starts, path))
    plain = suffixes._Chunk(raw, starts)
    assert seen == [suffixes.GRAM, suffixes.LONG_GRAM, suffixes.GRAM]
    assert np.array_equal(c.at, plain.at) and np.array_equal(c.key, plain.key) and np.array_equal(c.length, plain.length)
