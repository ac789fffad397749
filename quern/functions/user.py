"""Functions of one's own for SQL: vectorized scalars, aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str):
    """``f`` gets and returns whole batches as Series."""
    return spark.udf.register(name, F.pandas_udf(f, returns))


def register_aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], float], returns: str):
    """``f`` gets all values of a group at once: for groups that fit a task."""

    def call(values: pd.Series) -> float:
        return f(values)

    return spark.udf.register(name, F.pandas_udf(call, returns))


def register_table_function(spark: SparkSession, name: str, f: Callable, returns: str):
    """``f(*args)`` yields tuples."""

    class Rows:
        def eval(self, *args):
            yield from f(*args)

    return spark.udtf.register(name, F.udtf(Rows, returnType=returns))
