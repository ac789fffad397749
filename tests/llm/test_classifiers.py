"""Classifiers: held-out accuracy and odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import features, quality_classifier, toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(scored, spark, target):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", "score", target).collect()
    return np.array([[r["predicted"], r[target]] for r in rows])


def test_held_out_rows_follow_crc32(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 7, 12345, None)], "doc_id long")
    got = [r[0] for r in df.select(features.is_held_out(F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 == 0 for i in (0, 1, 7, 12345)] + [True]


def test_quality_on_held_out_rows(spark):
    scored = quality_classifier.op4_quality_classifier(spark, FOLDER)
    assert scored.count() == 10_000
    got = held_out(scored, spark, "quality")
    clean, junk = got[got[:, 1] == 1], got[got[:, 1] == 0]
    assert clean[:, 0].mean() >= 0.99 and junk[:, 0].mean() <= 0.05


def test_toxicity_on_held_out_rows(spark):
    scored = toxicity.op8_toxicity(spark, FOLDER)
    got = held_out(scored, spark, "toxic")
    toxic, clean = got[got[:, 1] == 1], got[got[:, 1] == 0]
    assert toxic[:, 0].mean() >= 0.85 and clean[:, 0].mean() <= 0.01


@pytest.mark.parametrize("run", [quality_classifier.op4_quality_classifier, toxicity.op8_toxicity])
def test_reruns_agree(spark, run):
    a, b = (sorted(map(tuple, run(spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a == b


def test_odd_and_no_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0, "x") for i in range(60)] + [(None, 1, 1, "x"), (3, None, 1, "x"), (4, 7, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for docs in (odd, none):
        for lab in (labels, labels.limit(0), labels.where("quality = 1")):
            got = quality_classifier.classify(docs, lab).collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
            got = toxicity.classify(docs, lab, ("quality", "toxic")).collect()
            assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_scores_do_not_depend_on_the_block():
    texts = ["one two three " * 40, "", None, "Ünï cödé wörds " * 300, "x"]
    who, what = quality_classifier.text_features(texts)
    for k, t in enumerate(texts):
        _, alone = quality_classifier.text_features([t])
        assert sorted(what[who == k]) == sorted(alone)


def test_features_are_those_of_the_text_alone():
    texts = ["foo bar", "bar baz qux qux", None, "qux", " qux qux ", "ab ab ab é é x x"]
    alone = {k: sorted(quality_classifier.text_features([t])[1]) for k, t in enumerate(texts)}
    again = quality_classifier.AGAIN % quality_classifier.BUCKETS
    assert [alone[k].count(again) for k in range(len(texts))] == [sum(a == b for a, b in zip((t or "").split(), (t or "").split()[1:])) for t in texts]
    for order in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [3, 4, 3, 1, 0, 1]):
        for block in range(1, 40):
            who, what = quality_classifier.text_features([texts[k] for k in order], block=block)
            assert [sorted(what[who == i]) for i in range(len(order))] == [alone[k] for k in order]


def test_model_learns_from_character_n_grams():
    rng = np.random.default_rng(0)
    texts = [" ".join(("zq" if y else "") + "".join(rng.choice(list("abcdef"), 6)) for _ in range(30)) for y in (0, 1) * 100]
    y = np.array([0, 1] * 100)
    model = quality_classifier.fit(texts[:150], y[:150])
    assert ((model.scores(texts[150:]) >= 0.5) == y[150:]).all()


def test_a_chain_of_three_learns_from_folds_left_out():
    rng = np.random.default_rng(1)
    n = 600
    first, noise = rng.integers(0, 2, n), rng.integers(0, 2, n)
    texts = [" ".join(["badword"] * (3 * a) + ["other"] * b + [f"w{rng.integers(2000)}" for _ in range(20)]) for a, b in zip(first, noise)]
    # The second can't be learned at all: a model that saw its own rows would trust it.
    chance = rng.integers(0, 2, n)
    chain = toxicity.fit_chain(texts[:400], {"a": first[:400], "b": chance[:400], "c": first[:400] * noise[:400]})
    p = chain.probabilities(texts[400:])
    assert p.shape == (200, 3) and ((p[:, 2] >= 0.5) == (first * noise)[400:]).mean() > 0.95
    assert abs(chain.links[2].earlier[1]) < abs(chain.links[2].earlier[0])


def test_chain_uses_the_earlier_category():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.integers(0, 2, n)
    texts = [" ".join(["badword"] * (3 * a) + [f"w{rng.integers(2000)}" for _ in range(20)]) for a in first]
    chain = toxicity.fit_chain(texts[:300], {"a": first[:300], "b": first[:300]})
    p = chain.probabilities(texts[300:])
    assert ((p[:, 1] >= 0.5) == first[300:]).all() and chain.links[1].earlier[0] > 0
