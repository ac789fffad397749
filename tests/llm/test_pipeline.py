"""The pipeline's stages, applied in turn."""

from __future__ import annotations

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quern.llm import bpe, mixing, quality_rules, simhash, suffix_dedup  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_run_ends_in_tokens_of_kept_documents(spark):
    ranks = bpe.read_ranks(bpe.default_ranks())
    pieces = {r: p for p, r in ranks.items()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    run = corpus_pipeline.run(spark, FOLDER).collect()
    assert 0 < len({r["doc_id"] for r in run}) < len(docs)
    for r in run:
        raw = b"".join(pieces[i] for i in r["ids"])
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        assert len(raw) <= len(docs[r["doc_id"]].encode())


def test_each_stage_follows_its_operator(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = {r["doc_id"] for r in quality_rules.assess(docs).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, FOLDER).collect()} == rules
    near = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()} == near
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removal_digests(suffix_dedup.with_spans(docs)).collect()}
    lens = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
    for r in corpus_pipeline.repeat_stage(spark, docs, FOLDER).collect():
        cut = lens[r["doc_id"]] - len(r["text"].encode())
        assert removed[r["doc_id"]] * 0.9 - 8 <= cut <= removed[r["doc_id"]]
    copies = mixing.mix(docs).collect()
    mixed = [r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, FOLDER).collect()]
    assert sorted(mixed) == sorted(r["doc_id"] for r in copies for _ in range(r["copies"]))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_no_rows(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, none, FOLDER).collect() == []
    assert stage(spark, odd, FOLDER).count() > 0
