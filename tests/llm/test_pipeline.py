"""Every stage of the pipeline against brute force on what the stage before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SCHEMA, SF, odd_rows
from test_simhash import brute as brute_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import decontaminate, mixing, quality, tokenfile, toxicity
from graphloom.llm.common import save


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    at = {c: i for i, c in enumerate(docs.columns)}
    stages = dict(corpus_pipeline.STAGES)

    good = save(stages["quality"](spark, docs, sf))
    scores = toxicity.score(docs.select("doc_id", "text"), quality.fit(docs, labels)).collect()
    assert good.columns == docs.columns
    assert Counter(r[at["doc_id"]] for r in rows(good)) == Counter(r.doc_id for r in scores if r.score >= 0.5)
    assert not set(rows(good)) - set(rows(docs))

    apart = save(stages["near_dedup"](spark, good, sf))
    groups = brute_simhash([(r[at["doc_id"]], r[at["text"]]) for r in rows(good)])
    assert apart.columns == docs.columns
    assert {r[at["doc_id"]] for r in rows(apart)} >= {c for _, _, c in groups}
    assert apart.count() == len({c if c is not None else p for _, p, c in groups})

    clean = save(stages["decontamination"](spark, apart, sf))
    found = decontaminate.brute_force([(r, r[at["text"]]) for r in rows(apart)], items)
    assert rows(clean) == sorted((r for r, *_, bad in found if not bad), key=repr)

    mixed = save(stages["mixing"](spark, clean, sf))
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixing.mix_counts(clean).collect():
        if r["size"]:
            taken[r.doc_id] += r.taken // r["size"]
    assert Counter(r[at["doc_id"]] for r in rows(mixed)) == +taken

    out = sorted(stages["token_output"](spark, mixed, sf).collect(), key=lambda r: r.start)
    t, start = Tokenizer.from_file(tokenfile.default_tokenizer()), 0
    want = sorted(((i is not None, i or 0), len(x := [*t.encode(s or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s in ((r[at["doc_id"]], r[at["text"]]) for r in rows(mixed)))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in out) == want
    for r in out:
        assert r.start == start
        start += r.n_tokens
    return out


def test_documents(spark):
    want = check(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert rows(corpus_pipeline.run(spark, SF)) == sorted((tuple(r) for r in want), key=repr)


@pytest.mark.parametrize("n", [0, None])
def test_odd(spark, n):
    check(spark, spark.createDataFrame(odd_rows()[:n], SCHEMA), SF)
