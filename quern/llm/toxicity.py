"""Toxicity by a chain of linear classifiers.

Categories are predicted in a given order, each by a logistic regression on
hashed words and word beginnings, and on the probabilities of the categories
before it. While the chain is fitted, these probabilities come from models of
other folds, so a later model sees earlier ones as wrong as they are on new
documents; for new documents the models of all training rows are used.

Features are screened before each fit: a bucket stays if its share among the
documents of the category stands out from that among the others by its z-score;
the ``MAX_FEATURES`` best stay. A feature's value is log(1 + count), and the
regression is solved by Newton steps with a ridge, in numpy, on a bounded
sample of labelled rows (features' ``MAX_TRAIN_ROWS``). Scoring hashes all
words of a block of texts at once.

Defined results: null and empty texts have the probability of the biases; a
category without labels of both kinds always has the share of its label 1 (0
without any labels). Repeated rows are scored one by one; of several texts with
one labelled id the least teaches. Long texts are hashed block by block; an
empty table gives no scores; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table
from quern.llm.features import MAX_TRAIN_ROWS, is_held_out, sigmoid, training_rows
from quern.llm.quality_classifier import blocks_of

BUCKETS = 1 << 20
#: Bytes of word beginnings.
STEMS = (5, 6, 7, 8, 9)
MAX_FEATURES = 400
MIN_DOCS = 4
MIN_Z = 4.0
RIDGE = 0.5
FOLDS = 3
THRESHOLD = 0.3
#: The order of the query's chain: what ``labels`` offers.
CHAIN = ("low_quality", "toxic")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
#: Bytes of words: letters, digits and all that isn't ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_features(data: np.ndarray, buckets: int = BUCKETS):
    """Arrays (place, bucket) of the words and word beginnings of a block."""
    n = len(data)
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    places, found = [], []
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values = _VALUE[data]
    h = np.zeros(len(first), np.uint64)
    for k in range(max(STEMS)):
        here = first + k < last
        h = np.where(here, (h + values[np.minimum(first + k, n - 1)]) * _MULT, h)
        h = np.where(here, h ^ (h >> np.uint64(29)), h)
        if k + 1 in STEMS:
            places.append(first[here])
            found.append(h[here] + np.uint64(k + 1))
    starts = np.zeros(n, np.int64)
    starts[first] = np.diff(np.r_[0, first])
    place = np.arange(n) - np.cumsum(starts)
    mixed = values * (2 * (place % 4096).astype(np.uint64) + np.uint64(1))
    mixed = np.where(inside, (mixed ^ (mixed >> np.uint64(29))) * _MULT, np.uint64(0))
    total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
    places.append(first)
    found.append(total[last] - total[first])
    h = np.concatenate(found) * _MULT
    return np.concatenate(places), ((h ^ (h >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def text_counts(texts: list[str | None], buckets: int = BUCKETS, column: np.ndarray | None = None):
    """Arrays (text, feature, count); with ``column``, only of features that have a column there."""
    who, what = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for data, starts, numbers in blocks_of(texts):
        place, bucket = word_features(data, buckets)
        if column is not None:
            bucket = column[bucket].astype(np.int64)
            place, bucket = place[bucket >= 0], bucket[bucket >= 0]
        who.append(numbers[np.searchsorted(starts, place, "right") - 1])
        what.append(bucket)
    pair, count = np.unique(np.concatenate(who) * buckets + np.concatenate(what), return_counts=True)
    return pair // buckets, pair % buckets, count


@dataclass
class Link:
    """One model of the chain: weights of its features and of earlier probabilities."""

    name: str
    column: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, texts: list[str | None], before: np.ndarray) -> np.ndarray:
        who, col, count = text_counts(texts, len(self.column), self.column)
        return self._finish(np.bincount(who, self.weight[col] * np.log1p(count), len(texts)), before)

    def _finish(self, logit: np.ndarray, before: np.ndarray) -> np.ndarray:
        return sigmoid(logit + before @ self.earlier + self.bias)


def screen(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, buckets: int, most: int = MAX_FEATURES) -> np.ndarray:
    """The buckets whose share among the category's documents stands out most."""
    with_, without = np.bincount(bucket, y[doc], buckets), np.bincount(bucket, 1 - y[doc], buckets)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    both = (with_ + without) / (n1 + n0)
    z = (with_ / n1 - without / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    z[with_ + without < MIN_DOCS] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    return np.sort(best[np.abs(z[best]) >= MIN_Z])


def fit_link(name: str, counts, y: np.ndarray, before: np.ndarray, buckets: int = BUCKETS, ridge: float = RIDGE) -> Link:
    """A ridge logistic regression by Newton steps."""
    column = np.full(buckets, -1, np.int16)
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Link(name, column, np.zeros(0), np.zeros(before.shape[1]), float(np.log(p / (1 - p))))
    doc, bucket, count = counts
    chosen = screen(doc, bucket, y, buckets)
    column[chosen] = np.arange(len(chosen))
    kept = column[bucket] >= 0
    x = np.zeros((len(y), len(chosen) + before.shape[1] + 1))
    x[doc[kept], column[bucket[kept]]] = np.log1p(count[kept])
    x[:, len(chosen) : -1] = before
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return Link(name, column, w[: len(chosen)], w[len(chosen) : -1], float(w[-1]))


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """One column per category, in the order of the chain."""
        out = np.zeros((len(texts), 0))
        for link in self.links:
            out = np.c_[out, link.probability(texts, out)]
        return out


def fit_chain(texts: list[str], targets: dict[str, np.ndarray], folds: int = FOLDS, buckets: int = BUCKETS) -> Chain:
    """Fit the categories in order; later ones are trained with out-of-fold probabilities."""
    counts = text_counts(texts, buckets)
    n = len(texts)
    fold = np.arange(n) % folds
    chain, before = Chain(), np.zeros((n, 0))
    for name, y in targets.items():
        y = np.asarray(y, np.float64)
        chain.links.append(fit_link(name, counts, y, before, buckets))
        out = np.zeros(n)
        for k in range(folds if n else 0):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            number = np.full(n, -1)
            number[rest] = np.arange(len(rest))
            use = number[counts[0]] >= 0
            part = fit_link(name, (number[counts[0][use]], counts[1][use], counts[2][use]), y[rest], before[rest], buckets)
            hit = (fold[counts[0]] == k) & (part.column[counts[1]] >= 0)
            logit = np.bincount(counts[0][hit], part.weight[part.column[counts[1][hit]]] * np.log1p(counts[2][hit]), n)
            out[own] = part._finish(logit, before)[own]
        before = np.c_[before, out]
    return chain


def score_documents(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one probability ``p_<category>`` per category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.probabilities(texts.tolist())))

    scored = docs.select(F.col(doc_id).alias("doc_id"), score(F.col(text)).alias("p"))
    return scored.select("doc_id", *[F.get("p", F.lit(k)).alias(f"p_{link.name}") for k, link in enumerate(chain.links)])


def classify(docs: DataFrame, labels: DataFrame, chain=CHAIN, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, the categories' probabilities, score and predicted (of the last category).

    ``labels``: doc_id and a 0/1 column for each category.
    """
    rows = training_rows(docs, labels, list(chain), max_rows)
    fitted = fit_chain(rows["text"].tolist(), {c: rows[c].to_numpy() for c in chain})
    scored = score_documents(docs, fitted)
    last = F.col(f"p_{chain[-1]}")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), *[f"p_{c}" for c in chain[:-1]], last.alias("score"), (last >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: is it toxic? The chain predicts low quality first."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return classify(table(spark, sf_dir, "documents"), labels)
