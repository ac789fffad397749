"""Orders with explicit places for nulls, top-n and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(name: str, descending: bool = False, nulls_first: bool = False) -> Column:
    """A sort key; nulls come last unless asked otherwise, in either direction."""
    c = F.col(name)
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def top_n(df: DataFrame, keys, n: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + n of an order; each task keeps that many only."""
    ordered = df.orderBy(*keys)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def limit_percent(df: DataFrame, keys, percent: float) -> DataFrame:
    """The first ``percent`` of the rows in an order, rounded down: a count, then a top-n."""
    if not 0 <= percent <= 100:
        raise ValueError("percent is from 0 to 100")
    return top_n(df, keys, int(df.count() * percent / 100))


def sample_rows(df: DataFrame, fraction: float, keys, seed: int = 0) -> DataFrame:
    """A sample that depends on the keys only, not on how rows are dealt."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(fraction * 1_000_000))
