"""Counts after edits against counting the edited text as a whole."""

import base64
import random
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from conftest_llm import SF, tuples
from pyspark.sql import functions as F

from graphloom.llm import tokencounts as tc
from graphloom.llm.common import save

PATH = P.path("byte_bpe_50k.tiktoken")


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(rows):
    enc, out = encoder(), []
    for i, t in rows:
        t = t or ""
        n, seed = len(t), zlib.crc32(("" if i is None else str(i)).encode())
        e = t
        for pos, gone, new in ((seed % (n + 1), 0, " newly added, words"), (n // 2, 9, ""), (seed // 7 % (n + 1), 4, "Xy  ")):
            e = e[:pos] + new + e[pos + gone :]
        out.append((i, len(enc.encode_ordinary(t)), len(enc.encode_ordinary(e)), len(e)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_counts(request, which, monkeypatch):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    trees = save(tc.token_trees(df, PATH, P.PATTERN))
    assert tuples(tc.counts_after(trees, tc.sample_edits(), PATH, P.PATTERN), "doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited") == brute(rows)
    plain = tc.counts_after(trees, F.lit(None), PATH, P.PATTERN)
    assert not plain.where("n_tokens <> n_tokens_edited or n_recounted > 0").count()


def test_kept_trees(spark, odd):
    """Edits of trees that were kept, twice in a row; trees without edits stay as they are, and little is encoded again."""
    trees = save(tc.token_trees(odd, PATH, P.PATTERN))
    few = F.when(F.col("doc_id") % 3 == 0, tc.sample_edits())
    once = save(tc.edited_trees(trees, few, PATH, P.PATTERN))
    twice = tc.edited_trees(once.drop("n_recounted"), few, PATH, P.PATTERN).collect()
    enc, old = encoder(), [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]

    def after(i, t):
        if i is None or i % 3:
            return t
        n, seed = len(t), zlib.crc32(str(i).encode())
        for pos, gone, new in ((seed % (n + 1), 0, " newly added, words"), (n // 2, 9, ""), (seed // 7 % (n + 1), 4, "Xy  ")):
            t = t[:pos] + new + t[pos + gone :]
        return t

    want = sorted(((i, after(i, after(i, t))) for i, t in old), key=repr)
    assert sorted(((r.doc_id, "".join(r.leaves)) for r in twice), key=repr) == want
    assert sorted(((r.doc_id, r.n_tokens, r.n_chars) for r in twice), key=repr) == sorted(((i, len(enc.encode_ordinary(t)), len(t)) for i, t in want), key=repr)
    assert all(r.n_tokens == sum(r.leaf_tokens) and r.n_pretokens == sum(r.leaf_pretokens) for r in twice)
    assert not [r for r in twice if r.n_recounted and (r.doc_id is None or r.doc_id % 3)]
    assert sum(r.n_recounted for r in twice) < 3 * 8 * tc.LEAF * len(twice) < sum(r.n_pretokens for r in twice)


def test_query(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert tuples(tc.op4_token_counts(spark, SF), "doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited") == brute(rows)


def test_random_edits(monkeypatch):
    monkeypatch.setattr(tc, "PIECE", 500)
    monkeypatch.setattr(tc, "MOST_LEAF", 40)
    rng, known, enc = random.Random(4), tc.Counts(PATH, P.PATTERN), encoder()
    parts = ["a", "Word", " ", "  ", "\n", "\n\n ", "12", "é", "don't", "!?", "日本", "\t", "'s", " the", "longerword"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(25):
        now = text(rng.choice([0, 1, 30, 3000]))
        tree = tc.TokenTree.of(now, known)
        for _ in range(12):
            pos, gone, new = rng.randint(0, len(now) + 2), rng.choice([0, 1, 5, 300]), text(rng.choice([0, 1, 3, 400]))
            tree.edit(pos, gone, new)
            pos = min(pos, len(now))
            now = now[:pos] + new + now[pos + gone :]
            assert tree.text() == now
            assert tree.n_tokens == len(enc.encode_ordinary(now))
            assert tree.n_pretokens == len(known.split(now))


def test_an_edit_counts_little():
    known = tc.Counts(PATH, P.PATTERN)
    tree = tc.TokenTree.of("some plain words, again and again. " * 5000, known)
    tree.edit(80_000, 3, "new")
    assert tree.recounted < 8 * tc.LEAF
