"""BPE against the library of the same name as its rank files."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.default_ranks())


@pytest.fixture(scope="module")
def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    parts = [*"  \n\t\r\x0b\x0c\x1c\x85\xa0　​'sAb1٣²½éßü漢字🎉<|endoftext|>́", "'s", "'ll", "a" * 50, "xyz" * 300]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)] + [None, ""]


@pytest.mark.parametrize("fold", ["arrays", "sql"])
def test_ids_and_bytes(spark, ranks, reference, fold):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.encode(df, ranks, fold=fold, block_bytes=2000).withColumn("back", bpe.decode(F.col("ids"), ranks)).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(text)
        assert bytes(r["back"]) == text.encode()


def test_query_on_documents(spark, ranks, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = reference.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_and_no_rows(odd, none, ranks):
    assert bpe.digests(bpe.encode(odd, ranks), ranks).count() == odd.count()
    assert bpe.digests(bpe.encode(none, ranks), ranks).collect() == []


def test_long_texts_without_a_break(spark, ranks, reference):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "".join(rng.choices("漢字日本語", k=60_000)), "a" * 5000 + " " + "".join(rng.choices("ab", k=700))]
    rank_map = bpe.RankMap(ranks)
    flat, lens = bpe.fold_merges(*bpe._byte_symbols([texts[0].encode(), b"ab", texts[1].encode()], ranks), rank_map)
    want = [reference.encode_ordinary(t) for t in (texts[0], "ab", texts[1])]
    assert flat.tolist() == [i for w in want for i in w] and lens.tolist() == list(map(len, want))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.digests(bpe.encode(df, ranks), ranks).collect():
        assert r["n_tokens"] == len(reference.encode_ordinary(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
