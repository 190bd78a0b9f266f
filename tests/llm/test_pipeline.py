"""The pipeline's stages and its whole run against a brute-force version."""

from collections import defaultdict

import numpy as np
import pytest
from test_dedup import root_of, shingles

pytest.importorskip("public_tokenizers")
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, D), name)
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    rows = lambda name: {r.doc_id: r.text for r in kept[name].collect()}
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    lettered = {i: t for i, t in source.items() if t and any(c.isalpha() for c in t)}
    assert rows("language_id") == lettered
    last = defaultdict(int)
    for i, t in lettered.items():
        last[t] = max(last[t], i)
    unique = {i: t for i, t in lettered.items() if last[t] == i}
    assert rows("exact_dedup") == unique
    ids = sorted(unique)
    sets = [shingles(unique[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert set(rows("minhash_near_dedup")) == {i for k, i in enumerate(ids) if root_of(links, len(ids))[k] == k}
    cut = rows("substring_dedup")
    t, want = Tokenizer.from_file(path("byte_bpe_50k.json")), 0
    for text in cut.values():
        want += len(t.encode(text, add_special_tokens=False).ids) + 1
    packed = kept["best_fit_packing"].collect()
    assert sum(r.length for r in packed) == want and {r.doc_id for r in packed} == set(cut)
    size = defaultdict(int)
    for r in packed:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 1024 and len(size) <= np.ceil(want / 1024) + 3


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0
