"""The corpus pipeline against brute-force forms of its stages."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np

from ..conftest import DATA
from .test_llm_operators import classes_by_hand


def test_stages_one_by_one(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    quality, near, clean, secret, pack = [f for _, f in corpus_pipeline.STAGES]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    kept = quality(spark, docs, d)
    assert kept.columns == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i not in ids for i, q in labels.items() if q == 1) <= 0.02 * len(labels)
    rows = sorted(docs.collect())
    near_ids = {r.doc_id for r in near(spark, docs, d).collect()}
    assert near_ids == {rows[i].doc_id for i in classes_by_hand([r.text for r in rows])}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(len(w) - 9)}
    free = {r.doc_id for r in rows if not any(tuple(w[i : i + 10]) in wins for w in [words(r.text)] for i in range(len(w) - 9))}
    assert {r.doc_id for r in clean(spark, docs, d).collect()} == free
    out = {r.doc_id: r.text for r in secret(spark, docs, d).collect()}
    assert out == {r.doc_id: re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', r.text) for r in rows}


def test_run_by_hand(spark):
    """The whole run against a brute-force one; which documents the model rejects is taken from its stage."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from quarrystone.llm import packing

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, docs, d).collect())
    firsts = sorted(set(classes_by_hand([t for _, t in rows])))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9))}
    kept = [rows[i] for i in firsts if not any(tuple(w[j : j + 10]) in wins for w in [words(rows[i][1])] for j in range(len(w) - 9))]
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in kept:
        own = np.array(tok.encode(re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', t), add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for size in packing.cut(len(own), packing.piece_sizes(2048, 64)):
            want[i, at, size, zlib.crc32(own[at : at + size].tobytes()), len(own)] += 1
            at += size
    out = corpus_pipeline.run(spark, d).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want and len(out) > 100


def test_odd_documents(spark):
    d = f"{DATA}/sf0.001"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (1, "other words here", None, None, 3), (2, "x " * 30000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", *[f"'clash' AS {c}" for c in ("score", "tkey", "n_hit", "findings", "length", "_k", "class_id")])
    quality, near, clean, secret, pack = [f for _, f in corpus_pipeline.STAGES]
    assert [sorted(map(str, f(spark, wide, d).collect())) == sorted(map(str, docs.collect())) for f in (clean, secret)] == [True, True]
    assert sorted((r.doc_id, r.text) for r in near(spark, wide, d).collect()) == [(1, ""), (1, "other words here"), (2, "x " * 30000)]
    kept = quality(spark, wide, d).collect()
    assert {tuple(r) for r in kept} <= set(rows) and len({r.text or "" for r in kept} & {"", None}) in (0, 1)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pack(spark, wide, d).collect() if r.start == 0) == [("1", 1), ("1", 1), ("1", 4), ("2", 30001), ("None", 1)]
    for stage in (quality, near, clean, secret, pack):
        assert stage(spark, wide.limit(0), d).count() == 0
