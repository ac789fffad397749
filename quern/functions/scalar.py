"""Scalar functions that Spark spells otherwise or answers otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(text: Column, start: int, length: int) -> Column:
    """Characters from a 1-based start; place 0 is one before the first and holds none."""
    if start == 0:
        return F.substring(text, 1, max(length - 1, 0))
    return F.substring(text, start, length)


def like(text: Column, pattern: str) -> Column:
    """LIKE without an escape character: a backslash is itself."""
    return text.like(pattern.replace("\\", "\\\\"))


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def char_length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def concat_skip(*parts: Column) -> Column:
    """concat(): nulls are skipped."""
    return F.concat_ws("", *parts)


def concat_strict(*parts: Column) -> Column:
    """The operator ||: null if any part is."""
    return F.concat(*parts)


def regexp_replace_all(text: Column, pattern: str, to: str) -> Column:
    """Replace every match; ``\\1`` in ``to`` stands for the first group."""
    return F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", to.replace("$", r"\$")))


def regexp_replace_first(text: Column, pattern: str, to: str) -> Column:
    """Replace the first match."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})(.*)$", "$1" + re.sub(r"[$\\]", r"\\\g<0>", to) + "$2")


def int_divide(a: Column, b: Column) -> Column:
    """Whole quotient towards zero; null for a zero divisor."""
    b = F.nullif(b, F.lit(0))
    return ((a - a % b) / b).cast("long")


def subsecond(ts: Column, per_second: int) -> Column:
    """Seconds within the minute in units of 1 / per_second: 1000 or 1000000."""
    micros = F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)") * 1_000_000
    return F.floor(micros.cast("long") / (1_000_000 // per_second)).cast("long")


def date_trunc(unit: str, ts: Column) -> Column:
    """Without a time zone, as the input."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def cast_rounded(x: Column, kind: str) -> Column:
    """A number as an integer type, rounded instead of cut."""
    return F.round(x).cast(kind)
