"""Word windows against a dictionary of all of them."""

import re

import numpy as np
import pytest
from conftest_llm import SF, tuples
from pyspark.sql import functions as F

from graphloom.llm import stretches, substrings


def brute(rows, window=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, 1 << 63), 1 << 63 if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (1 << 63 if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [None, 1 << 16])
@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_substrings(request, which, cells, monkeypatch):
    df = request.getfixturevalue(which)
    if cells:
        monkeypatch.setattr(stretches, "HELD", 1000)
        monkeypatch.setattr(stretches, "BROADCAST_SPANS", -1)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = substrings.substring_dedup(df, cells=cells)
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept") == brute(rows)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_query(spark, docs):
    import hashlib

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = tuples(substrings.op9_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows)), key=repr)


def thue_morse(n, swap):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out.translate(str.maketrans("ab", "ba")) if swap else out


def test_words_whose_hashes_collide(spark):
    """Different words of 2,048 letters that share a polynomial hash: windows that hold them are not equal."""
    from graphloom.llm import textbytes as tb

    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{thue_morse(2048, False)} {tail}"), (2, f"{thue_morse(2048, True)} {tail}"), (3, f"{thue_morse(2048, True)}  {tail}")]
    raw = f"{thue_morse(2048, False)} {thue_morse(2048, True)}".encode()
    h = tb.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert h[0] == h[1]
    got = {r.doc_id: r.n_removed for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("kind", ["string", "date", "int"])
def test_ids_of_other_types(spark, docs, kind):
    """Ids that are no longs, in their own order, null last."""
    named = {"string": F.concat(F.lit("d"), F.col("doc_id") * 7 % 1000), "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int")), "int": -F.col("doc_id").cast("int")}[kind]
    df = docs.withColumn("doc_id", F.when(F.col("doc_id") % 50 != 3, named))
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    order = {i: n for n, i in enumerate(sorted({i for i, _ in rows if i is not None}))}
    want = sorted(((n, m) for _, n, m, _ in brute([(order.get(i), t) for i, t in rows])))
    assert sorted((r.n_words, r.n_removed) for r in substrings.substring_dedup(df).collect()) == want
    from graphloom.llm import suffixes
    from test_suffixes import brute as brute_bytes

    want = sorted((n, m, k, sha) for _, n, m, k, sha in brute_bytes([(order.get(i), t) for i, t in rows]))
    import hashlib

    assert sorted((r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.suffix_dedup(df).collect()) == want
