"""Windows that Spark doesn't spell: QUALIFY, and frames of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, value: Column, condition) -> DataFrame:
    """Rows for which ``condition`` of a window expression holds; the value isn't returned."""
    return df.withColumn("__q", value).where(condition(F.col("__q"))).drop("__q")


def top_per_group(df: DataFrame, partition, order, n: int) -> DataFrame:
    return qualify(df, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)), lambda r: r <= n)


def groups_frame(df: DataFrame, partition, order: str, aggregate, start: int, end: int, name: str) -> DataFrame:
    """``aggregate`` over peers from ``start`` to ``end`` groups away (GROUPS BETWEEN): ranges over the dense rank."""
    ranked = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(F.col(order).asc_nulls_last())))
    return ranked.withColumn(name, aggregate.over(Window.partitionBy(*partition).orderBy("__g").rangeBetween(start, end))).drop("__g")


def sessionize(df: DataFrame, partition, time: str, gap_seconds: int, name: str = "session") -> DataFrame:
    """Adds the number of the session, which a pause of over ``gap_seconds`` ends."""
    w = Window.partitionBy(*partition).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
