"""Hashed text features and helpers to learn from a bounded sample of labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are used to fit a model at most; those with the smallest hashes.
MAX_TRAIN_ROWS = 4000


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; rows without id are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, targets: list[str], max_rows: int = MAX_TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """text and targets of at most ``max_rows`` labelled documents that aren't held out.

    Rows without a text or a 0/1 value for each target are left out. The choice
    follows a hash of the id, so it doesn't depend on the order of the rows; of
    several texts with one id the least is taken.
    Only the labelled ids are joined with the texts, and only the chosen rows
    come to the driver.
    """
    given = labels.select(F.col("doc_id").alias("__id"), *[F.col(t).cast("int").alias(t) for t in targets])
    given = given.where(~is_held_out(F.col("__id"))).dropna()
    for t in targets:
        given = given.where(F.col(t).isin(0, 1))
    chosen = given.groupBy("__id").agg(*[F.max(t).alias(t) for t in targets]).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    # The chosen rows are bounded by max_rows, so they may be broadcast.
    found = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = found.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    once = rows.groupBy("__doc").agg(F.min("text").alias("text"), *[F.max(t).alias(t) for t in targets])
    return once.toPandas().sort_values("__doc").reset_index(drop=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
