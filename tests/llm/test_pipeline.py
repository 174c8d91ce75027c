import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from .test_minhash_dedup import brute as near
from .test_substring_dedup import brute as substring

ROOT = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(None, "no id here", None, None, None), (90001, None, "en", "s", 0), (90002, "", None, "s", 0)], docs.schema))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, ROOT)
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = before, docs
    before, after = kept["MinHash near-dedup"]
    assert sorted((r.doc_id for r in after.collect()), key=str) == sorted((r[0] for r in near(before) if r[3]), key=str)
    before, after = kept["substring dedup"]
    want = sorted(((i, n - gone) for i, n, gone, text in substring(before) if not (gone and not text)), key=str)
    assert sorted(((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in after.collect()), key=str) == want
    before, after = kept["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r.length for r in after.collect()) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    before, after = kept["quality classifier"]
    left = {r.doc_id for r in after.collect()}
    assert {None, 90001, 90002} <= left
    clean = [i for i, _ in before if labels.get(i) == 1]
    assert np.mean([i in left for i in clean]) > 0.95


def test_repeated_rows_stay_once(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, long), (1, long), (2, "a b"), (2, "a b"), (2, "other words"), (3, long), (4, None), (4, None), (None, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, ROOT)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    want = [(1, long), (2, "a b"), (2, "other words"), (4, None), (None, "a b"), (None, "a b")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
