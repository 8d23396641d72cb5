"""Fingerprints and components against all pairs."""

import random

import pytest
from conftest_llm import SF, tuples
from xxhash import xxh64_intdigest

from graphloom.llm import simhash


def brute_print(text, n=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=4):
    prints = [(i, brute_print(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return sorted(((i, f"{p:016x}", least.get(find(p))) for i, p in prints), key=repr)


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_simhash(request, which, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr("graphloom.llm.common.PIECE", 1000)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert tuples(simhash.simhash_dedup(df), "doc_id", "fingerprint", "component_id") == brute(rows)


def test_query(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert tuples(simhash.op8_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == brute(rows)


@pytest.mark.parametrize("group", [3, 50, 4096])
def test_links_join_what_all_pairs_join(spark, group):
    rng = random.Random(group)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for p in list(fps)[:25]:
        for _ in range(20):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            fps.add(p)
    fps = sorted(fps)
    root = {p: p for p in fps}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in fps}
    df = spark.createDataFrame([(signed[p],) for p in fps], "fp long")
    edges = simhash.links(df, 4, group)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in edges.collect())
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = {}
    for p in fps:
        groups.setdefault(find(p), []).append(signed[p])
    for g in groups.values():
        assert {got.get(p, p) for p in g} == {min(g)}


def test_masks_share_a_block():
    rng = random.Random(5)
    for rows in (10, 10**5, 10**7, 10**9, 10**11):
        masks = simhash.block_masks(rows)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)
