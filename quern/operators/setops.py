"""Set operations over two inputs with the same columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*inputs: DataFrame) -> DataFrame:
    """By place, with the types of the first and second reconciled and so on."""
    return reduce(DataFrame.union, inputs)


def union_distinct(*inputs: DataFrame) -> DataFrame:
    return union_all(*inputs).distinct()


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)
