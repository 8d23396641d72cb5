"""Mixing, decontamination, token output and exact dedup against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import SF, odd_rows, tuples

from graphloom.llm import decontaminate, exact, mixing, tokenfile


def plain(spark, df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("bits", [256, 4])
@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_exact(spark, request, which, bits):
    df = request.getfixturevalue(which)
    groups = defaultdict(list)
    for i, t in plain(spark, df):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want, kept = [], 0
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, keep, len(ids), sha) for i in ids]
    got = exact.exact_dedup(df, digest_bits=bits)
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    assert got.where("kept").count() == len(groups)
    assert not got.where("kept and not (doc_id <=> keep_id)").count()


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_mixing(spark, request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix_counts(df).collect()
    assert len(rows) == df.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.target, r.source_size].append(r)
    for (target, size), rs in by.items():
        assert target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in rs) - target) <= max(r["size"] for r in rs) / 2 + 1e-6
    assert tuples(mixing.mix_counts(df.repartition(5)), "doc_id", "taken") == tuples(mixing.mix_counts(df), "doc_id", "taken")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect())
    assert taken == sum(r.taken for r in rows)


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 0), ("d", 400)], "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in mixing.targets(sizes).collect()}
    want = {"a": 30.0, "c": 270.0, None: 0.0}  # capped at 3 times
    left, w = 1500 - 300, 2 + 1
    want |= {"b": left * 2 / w, "d": left * 1 / w}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(want)
    assert {k: v[0] for k, v in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}


@pytest.mark.parametrize("block", [1 << 24, 4000])
@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_decontamination(spark, request, which, block, monkeypatch):
    df = request.getfixturevalue(which)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    extra = [(900, "ALPHA0 beta1"), (901, None), (902, "one"), (None, "one two three"), (903, " - "), (10, "w7919 w15838 W23757 w1665 w9584 w17503 w25422 w3330 w11249 w19168 w27087 w4995")]
    bench = bench.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    want = decontaminate.brute_force(plain(spark, df), items + extra)
    found = decontaminate.contamination(df, bench)
    got = []
    for r in found.collect():
        spans = [(s.start, s.end) for s in r.spans]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        got.append((r.doc_id, r.n_words, sum(b - a for a, b in spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(spans)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decontamination_query(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = tuples(decontaminate.op3_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(decontaminate.brute_force(plain(spark, df), items), key=repr)


def test_decontamination_compares_words(spark):
    """Words of the test items and of a document that share a hash, but not their letters."""
    from test_substrings import thue_morse

    a, b = thue_morse(2048, False), thue_morse(2048, True)
    bench = spark.createDataFrame([(1, f"x {a} y"), (2, f"p {b} q")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"x {b} y"), (2, f"x {a.upper()} y"), (3, f"z p {b} q"), (4, f"p {a} q")], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in decontaminate.contamination(df, bench).collect()} == {1: [], 2: ["1"], 3: ["2"], 4: []}


def test_fm_index():
    rng = np.random.default_rng(0)
    for n, size in ((1, 1), (50, 2), (400, 5)):
        text = np.concatenate((rng.integers(0, size + 1, n), [0]))
        index = decontaminate.FMIndex(text, size)
        phrases = rng.integers(1, size + 1, (60, 4))
        length = rng.integers(1, 5, 60)
        low, high = index.search(phrases, length)
        for p, k, a, b in zip(phrases, length, low, high):
            want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_token_output(spark, request, which, monkeypatch):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(tokenfile.default_tokenizer())
    key = lambda x: (x[0] is not None, x[0] or 0)
    rows = sorted(plain(spark, df), key=key)
    got = sorted(tokenfile.token_output(df, tokenfile.default_tokenizer()).collect(), key=lambda r: r.start)
    want = sorted((key((i, 0)), len(ids := [*t.encode(x or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, x in rows)
    assert sorted((key((r.doc_id, 0)), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [key((r.doc_id, 0)) for r in got] == [key(r) for r in rows]


def test_token_output_case(spark):
    """Case is kept around special tokens' names; the plain words of such texts are lower-cased all the same."""
    from tokenizers import Tokenizer

    texts = ["Hello <|endoftext|> World", "The CAT sat", "x<|ENDOFTEXT|>Y The <|startoftext|>The", "If (A <|b) Then Ünder STRASSE"]
    t = Tokenizer.from_file(tokenfile.default_tokenizer())
    ids = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    got = tokenfile.token_output(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenfile.default_tokenizer()).collect()
    want = [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in sorted(got, key=lambda r: r.doc_id)] == np.cumsum([0, *map(len, ids)])[:-1].tolist()


def test_stretches_are_what_the_library_gives():
    """20,000 random texts: special tokens, mixed case, marks, and white space beyond ASCII."""
    import random

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.default_tokenizer())
    words, rng = tokenfile.encoder(tokenfile.default_tokenizer()), random.Random(8)
    assert isinstance(words, tokenfile.WordIds)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "<", "|", "Hello", "the", "THE", "MiXed", "a", "B", "1", "42", "'s", "'T", "'re", "it's", ".", ",", "!?", "...", ":", "#", "$5%", "_", "-", "é", "É", "e\u0301", "\u0301", "ñ", "İ", "ß", "日本", "😀", "\u00a0", "\u3000", "\u2028", "\x85", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u200b", "Ⅷ", "²", "ǅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    want = [[*x.ids, 2] for x in t.encode_batch(texts, add_special_tokens=False)]
    for lo in range(0, len(texts), 1000):
        raw = [x.encode() for x in texts[lo : lo + 1000]]
        starts = np.cumsum([0, *map(len, raw)])
        for encode in (words.encode, tokenfile.WholeIds(t).encode):
            ids, n = encode(np.frombuffer(b"".join(raw), np.uint8), starts, 2)
            got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
            assert [x for x in zip(texts[lo : lo + 1000], got, want[lo : lo + 1000]) if x[1] != x[2]] == []


def test_other_tokenizers_take_whole_texts():
    from tokenizers import Tokenizer

    config = Tokenizer.from_file(tokenfile.default_tokenizer()).to_str()
    assert tokenfile.by_stretches(config)
    assert not tokenfile.by_stretches(config.replace('"Lowercase"', '"Strip","strip_left":true,"strip_right":true').replace("NFC", "NFD"))
    assert not tokenfile.by_stretches(config.replace("<|endoftext|>", "[END]"))


def test_shard_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        ids = np.where(rng.random(n) < 0.02, rng.integers(0, 1 << 32, n), rng.integers(7, 9, n)).astype(np.uint32)
        lengths = np.array([n], np.int64) if n else np.empty(0, np.int64)
        data = tokenfile.encode_shard(ids, lengths)
        back, cut = tokenfile.decode_shard(data)
        assert (back == ids).all() and cut.tolist() == lengths.tolist()
        if n > 2048:
            assert (tokenfile.decode_shard(data, 1, 3)[0][:1024] == ids[1024:2048]).all()
