"""Exact decimals of up to 38 digits.

Overflow is an error (ANSI), division rounds half away from zero to a given
scale, integer division and modulo cut towards zero, and a null or zero divisor
gives null. Results of over 38 digits aren't approximated: they fail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 38


def _typed(x: Column, precision: int, scale: int) -> Column:
    if not 0 < precision <= MOST or not 0 <= scale <= precision:
        raise ValueError(f"decimal({precision},{scale}) isn't within {MOST} digits")
    return x.cast(f"decimal({precision},{scale})")


def add(a: Column, b: Column, precision: int = MOST, scale: int = 6) -> Column:
    return _typed(a + b, precision, scale)


def subtract(a: Column, b: Column, precision: int = MOST, scale: int = 6) -> Column:
    return _typed(a - b, precision, scale)


def multiply(a: Column, b: Column, precision: int = MOST, scale: int = 6) -> Column:
    return _typed(a * b, precision, scale)


def divide(a: Column, b: Column, precision: int = MOST, scale: int = 6) -> Column:
    return F.when(b != 0, _typed(F.round(a / F.nullif(b, F.lit(0)), scale), precision, scale))


def integer_divide(a: Column, b: Column) -> Column:
    q = (a - modulo(a, b)) / F.nullif(b, F.lit(0))
    return F.when(b != 0, _typed(F.round(q, 0), MOST, 0))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b != 0, a % F.nullif(b, F.lit(0)))


def negate(a: Column) -> Column:
    return -a


def exact_avg(x: Column, precision: int = MOST, scale: int = 6) -> Column:
    """The mean, rounded once at its end."""
    return divide(F.sum(x.cast(f"decimal({MOST - 10},{scale})")), F.count(x), precision, scale)
