"""Documents with everything that may go wrong."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, carried string, label int, fp string, row string, spans string, size string, copies int, component_id string, kept string"
EXTRA = (7, "c", 1, "f", "r", "s", "z", 9, "k", "y")


def document(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None if text is None else len(text), *EXTRA)


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "漢字", "🎉", "zeta,", "Eta.", "theta"]

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randint(0, 300)) for _ in range(n))

    long = text(4000)
    rows = [document(i, text(rng.randint(20, 80)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for i in range(60)]
    rows += [document(100, None), document(101, ""), document(102, " \t\n\x0b "), document(103, "one two"), document(104, long), document(105, long)]
    rows += [document(None, "no id at all " * 5), document(None, None, None, None), document(106, text(30), None, None)]
    rows += [rows[3], rows[3], rows[66]]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
