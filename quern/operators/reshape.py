"""Reshaping: unnest, pivot and unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, column: str, name: str, position: str | None = None, keep_empty: bool = False) -> DataFrame:
    """A row per element of an array, with its 1-based place if ``position`` names a column."""
    rest = [c for c in df.columns if c != column]
    if position is None:
        return df.select(*rest, (F.explode_outer if keep_empty else F.explode)(column).alias(name))
    out = df.select(*rest, (F.posexplode_outer if keep_empty else F.posexplode)(column).alias(position, name))
    return out.withColumn(position, F.col(position) + 1)


def pivot(df: DataFrame, keys, column: str, items, aggregate, default=None) -> DataFrame:
    """A column per item; the items are given, so that the data is read once."""
    out = df.groupBy(*keys).pivot(column, list(items)).agg(aggregate)
    return out if default is None else out.fillna(default, [str(i) for i in items])


def unpivot(df: DataFrame, keys, columns, name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], name, value)
