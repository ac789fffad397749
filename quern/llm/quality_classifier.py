"""Quality classifier with supervised subword embeddings.

A document is the average of the vectors of its features: hashed words, hashed
character n-grams of words with their edges marked, and one for each word that
repeats the word before it. A softmax over two
classes stands on top; vectors and weights are learned together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows (features'
``MAX_TRAIN_ROWS``), with the learning rate falling to zero.

The difference of the two classes' logits is linear in the average, so the
fitted model is one number per bucket, and scoring a document takes one look-up
per feature. All places of a block of texts are hashed at once, for each
n-gram length; memory follows the block, not the document.

Defined results: an empty or null text has the score of the bias alone; without
usable labels, or with labels of one class only, every score is the share of
label 1 (0.5 without any). Repeated rows are scored one by one; of several
texts with one labelled id the least teaches. A long text is hashed block by
block and scored as a whole; an empty table gives no scores; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.features import MAX_TRAIN_ROWS, is_held_out, sigmoid, training_rows

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = 8
RATE = 1.0
#: Factor of the vectors' learning rate: about the number of features of a document.
LIFT = 3000.0
BATCH = 32
SEED = 42
#: The feature of a word that repeats the one before.
AGAIN = 12_345
THRESHOLD = 0.3
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def block_features(data: np.ndarray, words: list, buckets: int = BUCKETS, grams=GRAMS):
    """Yield (place, bucket) arrays of the features of a block of bytes.

    Words are hashed by a sum of powers over their bytes, n-grams by their
    bytes; a space stands before and after each word and counts as its edge.
    Places and hashes of the words are appended to ``words``.
    """
    n = len(data)
    space = _SPACE[data]
    values = np.where(space, _BYTE[32], _BYTE[data])
    # Words: differences of a running sum that is weighted by the place in the word.
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    if len(first):
        inside = np.zeros(n, np.uint64)
        starts = np.zeros(n, np.int64)
        starts[first] = np.diff(np.r_[0, first])
        place = np.arange(n) - np.cumsum(starts)
        inside = values * (2 * (place % 4096).astype(np.uint64) + np.uint64(1)) * ~space
        inside = (inside ^ (inside >> np.uint64(29))) * _MULT
        inside[space] = 0
        total = np.r_[np.uint64(0), np.cumsum(inside, dtype=np.uint64)]
        word = total[last] - total[first] + np.uint64(1)
        words.append((first, word))
        yield first, _bucket(word, buckets)
    for g in grams:
        if n < g:
            continue
        h = np.zeros(n - g + 1, np.uint64)
        crossing = np.zeros(n - g + 1, bool)
        for k in range(g):
            h = (h + values[k : n - g + 1 + k]) * _MULT
            h ^= h >> np.uint64(32)
            if 0 < k < g - 1:
                crossing |= space[k : n - g + 1 + k]
        # An n-gram may begin or end with an edge, but lies in one word.
        at = np.flatnonzero(~crossing & ~(space[: n - g + 1] & space[g - 1 :]))
        yield at, _bucket(h[at] + np.uint64(g), buckets)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h * _MULT
    return ((h ^ (h >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def blocks_of(texts: list[str | None], block: int = BLOCK):
    """Yield (bytes, starts, numbers): texts with a space on each side, cut at a space if they are long."""
    parts, starts, numbers, size = [], [], [], 0
    for number, text in enumerate(texts):
        raw = b" " + (text or "").encode() + b" "
        at = 0
        while at < len(raw):
            stop = len(raw)
            if stop - at > block:
                cut = at + block
                while cut < stop and not _SPACE[raw[cut - 1]]:
                    cut += 1
                stop = cut
            piece = raw[at:stop] if at == 0 else b" " + raw[at:stop]
            parts.append(piece)
            starts.append(size)
            numbers.append(number)
            size += len(piece)
            at = stop
            if size >= block:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(numbers)
                parts, starts, numbers, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(numbers)


def features_of(texts: list[str | None], buckets: int = BUCKETS, grams=GRAMS, block: int = BLOCK):
    """Yield (text number, bucket) arrays of all features of some texts.

    A text's features depend on that text alone, wherever blocks begin and end.
    """
    last = (np.empty(0, np.int64), np.empty(0, np.uint64))  # text and hash of the word before the block
    for data, starts, numbers in blocks_of(texts, block):
        words = []
        for place, bucket in block_features(data, words, buckets, grams):
            yield numbers[np.searchsorted(starts, place, "right") - 1], bucket
        for first, word in words:
            who = np.r_[last[0], numbers[np.searchsorted(starts, first, "right") - 1]]
            word = np.r_[last[1], word]
            again = who[1:][(who[1:] == who[:-1]) & (word[1:] == word[:-1])]
            yield again, np.full(len(again), AGAIN % buckets)
            last = who[-1:], word[-1:]


def text_features(texts: list[str | None], buckets: int = BUCKETS, grams=GRAMS, block: int = BLOCK):
    """Arrays (text number, bucket) of all features of some texts."""
    who, what = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for text, bucket in features_of(texts, buckets, grams, block):
        who.append(text)
        what.append(bucket)
    return np.concatenate(who), np.concatenate(what)


@dataclass
class SubwordModel:
    """One logit per bucket and a bias; a text's logit is the mean over its features."""

    weight: np.ndarray
    bias: float
    grams: tuple = GRAMS

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for text, bucket in features_of(texts, len(self.weight), self.grams):
            total += np.bincount(text, self.weight[bucket], len(texts))
            count += np.bincount(text, minlength=len(texts))
        return sigmoid(total / np.maximum(count, 1) + self.bias)


def fit(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, grams=GRAMS, epochs: int = EPOCHS, rate: float = RATE, lift: float = LIFT, batch: int = BATCH, seed: int = SEED) -> SubwordModel:
    """Learn the vectors and the softmax by stochastic gradient descent."""
    labels = np.asarray(labels, np.int64)
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return SubwordModel(np.zeros(buckets, np.float32), float(np.log(p / (1 - p))), grams)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    batches = []
    for at in range(0, len(order), batch):
        rows = order[at : at + batch]
        who, what = text_features([texts[i] for i in rows], buckets, grams)
        pair, times = np.unique(what * batch + who, return_counts=True)
        what, who = pair // batch, pair % batch
        n = np.maximum(np.bincount(who, times, len(rows)), 1)
        cut = np.flatnonzero(np.r_[True, np.diff(what) > 0])
        col = np.cumsum(np.r_[0, np.diff(what) > 0]).astype(np.int32)
        matrix = (what[cut], col, who.astype(np.int32), (times / n[who]).astype(np.float32), cut)
        batches.append((labels[rows], len(rows), matrix))
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    soft, bias = np.zeros((dim, 2), np.float32), np.log(np.array([1 - share, share], np.float32))
    steps, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            y, n, (used, col, row, value, cut) = batches[k]
            lr = rate * (1 - steps / total)
            steps += 1
            own = vectors[used]
            doc = np.stack([np.bincount(row, value * own[col, d], n) for d in range(dim)], 1)
            logits = doc @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            back = p @ soft.T
            soft -= (lr / n) * (doc.T @ p).astype(np.float32)
            bias -= (lr / n) * p.sum(axis=0).astype(np.float32)
            # The average makes a vector's gradient small by the number of features; its rate makes up for it.
            vectors[used] -= (lr * lift / n) * np.add.reduceat((value[:, None] * back[row]).astype(np.float32), cut, axis=0)
    return SubwordModel((vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), grams)


def score_documents(docs: DataFrame, model: SubwordModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row. The model is broadcast: its size is fixed by its buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.select(F.col(doc_id).alias("doc_id"), score(F.col(text)).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD, **params) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``.

    ``labels`` (doc_id, quality); rows whose id is held out teach nothing.
    """
    rows = training_rows(docs, labels, ["quality"], max_rows)
    model = fit(rows["text"].tolist(), rows["quality"].to_numpy(), **params)
    scored = score_documents(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, scored by a model of the labelled ones."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
