"""Small literal tables with nulls, for Spark and for SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession

#: Every pair of a value that both sides have, one that only this side has, and null.
_LEFT_KEYS = list(product((3, 4, None), (50, 51, None)))
_RIGHT_KEYS = [*product((3, 5, None), (50, None)), (3, 50), (4, 52)]

#: name: (schema, rows). Keys meet never, once and repeatedly, with nulls on both sides;
#: measures are null in part of a group and in all of it; values stand on both sides of each bound.
FIXTURES = {
    "l": ("id int, k int", list(enumerate((7, 7, 8, 9, 3, None, None, 6)))),
    "r": ("rid int, rk int", list(enumerate((8, 8, 7, 5, None, 9, 9, None, 2), 60))),
    "mnl": ("id int, a int, b int", [(i, *k) for i, k in enumerate(_LEFT_KEYS)]),
    "mnr": ("rid int, ra int, rb int", [(i, *k) for i, k in enumerate(_RIGHT_KEYS, 30)]),
    "agg_n": ("g int, v int, d decimal(10,2), f double", [(g, v, None if v is None or v % 3 == 0 else f"{v}.25", None if v is not None and v % 2 else (v or 0) / 8) for g, values in ((4, (12, 3, None, 41, 8)), (5, (None, None)), (6, (6,)), (None, (7, None, 1500))) for v in values]),
    "nt": ("id int, i int, b bigint, dbl double, s string", [(k, i, b, f, s) for k, (i, b, f, s) in enumerate(product((4, 10, None), (-70, None), (1.5, 2.5, None), ("fig", "", None)), 1)] + [(90 + k, i, 9, 4.5, "12") for k, i in enumerate((0, 1, 11, 15, 20, 21))]),
    "ua": ("k int, v string", [(k, v) for k, v in zip((5, 6, 6, 7, None, 8), "pqqr" "uw")]),
    "ub": ("k int, v string", [(6, "q"), (7, "x"), (8, "w"), (8, "w"), (9, None), (None, "u")]),
    "cust": ("c_id int, c_grp int", [(k % 7 + 20, k % 3) for k in range(10)] + [(None, k) for k in (0, 2)]),
    "ord": ("o_id bigint, o_cust int, o_val int", [(500 + k, c, v) for k, (c, v) in enumerate(((21, 4), (21, 9), (22, None), (24, None), (24, 2), (24, 6), (99, 5), (None, 8), (None, None)))]),
    "pairs": ("a int, b int", [(1, None), (1, None), (None, None), (1, 2), (2, 1)]),
    "texts": ("id int, s string", [(1, "héllo wörld"), (2, "a\\b"), (3, ""), (4, None), (5, "aXbXc"), (6, "50%"), (7, "aaa")]),
    "nums": ("id int, a int, b int", [(1, 7, 2), (2, -7, 2), (3, 7, -2), (4, 0, 5), (5, None, 3), (6, 9, 3)]),
    "ts": ("id int, t timestamp_ntz", [(1, "2024-02-29 23:59:12.345678"), (2, "1999-12-31 00:00:00"), (3, None), (4, "2020-06-15 12:30:45.000001")]),
    "quotes": ("q_key int, q_time int, q_price int", [(1, 1, 10), (1, 5, 11), (1, 9, 12), (2, 2, 20), (2, 8, 21), (None, 1, 99)]),
    "trades": ("t_id int, t_key int, t_time int", [(1, 1, 0), (2, 1, 1), (3, 1, 7), (4, 1, 20), (5, 2, 5), (6, 3, 5), (7, None, 5), (8, 2, None)]),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split(" ", 1)[1] for c in schema.split(", ")]
    plain = ", ".join(f"{n} {k if k in ('int', 'bigint', 'double', 'string') else 'string'}" for n, k in zip(names, kinds))
    df = spark.createDataFrame(rows, plain)
    return df.select(*[df[n].cast(k).alias(n) for n, k in zip(names, kinds)])


def _literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def with_fixtures(*names: str) -> str:
    """A WITH list that has these tables in SQL."""
    kinds = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
    parts = []
    for name in names:
        schema, rows = FIXTURES[name]
        cols = [c.split(" ", 1) for c in schema.split(", ")]
        body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        casts = ", ".join(f"CAST({c} AS {kinds.get(k, k)}) AS {c}" for c, k in cols)
        parts.append(f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS v({', '.join(c for c, _ in cols)}))")
    return "WITH " + ", ".join(parts) + " "
