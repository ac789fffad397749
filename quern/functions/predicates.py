"""Predicates with SQL's three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_from(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM: nulls are equal, never unknown."""
    return ~a.eqNullSafe(b)


def every(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def some(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)


def between(x: Column, low, high, low_open: bool = False, high_open: bool = False) -> Column:
    """A range whose ends are in or out."""
    return ((x > low) if low_open else (x >= low)) & ((x < high) if high_open else (x <= high))


def in_list(x: Column, items) -> Column:
    """IN over a list that may hold null: unknown unless another item is equal."""
    known = [i for i in items if i is not None]
    found = x.isin(known) if known else F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return found if len(known) == len(items) else found | F.lit(None).cast("boolean")
