"""Joins beyond the plain ``DataFrame.join``.

Sides are joined on lists of column pairs, ``[("k", "k2"), ...]``; the right
side's columns must have names of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut_lineage

HOWS = ("inner", "left", "right", "full", "left_semi", "left_anti")
#: A side of at most this many rows may be broadcast, after it was counted.
BROADCAST_ROWS = 1_000_000
#: And of at most so many bytes, written as JSON.
BROADCAST_BYTES = 64 << 20


def keys_equal(left: DataFrame, right: DataFrame, pairs, null_safe=()) -> Column:
    """AND of the pairs; those whose left name is in ``null_safe`` match null with null."""
    parts = [left[a].eqNullSafe(right[b]) if a in null_safe else left[a] == right[b] for a, b in pairs]
    return reduce(Column.__and__, parts)


def join(left: DataFrame, right: DataFrame, pairs, how: str = "inner", null_safe=(), residual: Column | None = None) -> DataFrame:
    """An equi-join whose keys may be null-safe, with an optional residual predicate."""
    if how in ("right_semi", "right_anti"):
        swapped = [(b, a) for a, b in pairs]
        safe = [b for a, b in pairs if a in null_safe]
        return join(right, left, swapped, how.replace("right", "left"), safe, residual)
    if how not in HOWS:
        raise ValueError(f"how is one of {HOWS}")
    on = keys_equal(left, right, pairs, null_safe)
    return left.join(right, on if residual is None else on & residual, how)


def theta_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """A join on any predicate. Without an equality it compares all pairs: one side should be small."""
    return left.join(right, on, how)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if a bounded count of rows and bytes shows that the side is small; otherwise leave the choice to the planner."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def mark_in(left: DataFrame, right: DataFrame, key: str, among: str, mark: str = "mark") -> DataFrame:
    """``left`` with ``mark``: key IN (right.among) as TRUE, FALSE or null.

    Null when the key is null and the right side isn't empty, or when nothing
    matches and the right side has a null.
    """
    seen = right.select(F.col(among).alias("__in")).where("__in IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    stats = right.agg(F.count(F.lit(1)).alias("__n"), F.count(among).alias("__known"))
    joined = left.join(seen, F.col(key) == F.col("__in"), "left").join(F.broadcast(stats))
    value = (
        F.when(F.col("__n") == 0, F.lit(False))
        .when(F.col("__hit"), F.lit(True))
        .when(F.col(key).isNull() | (F.col("__known") < F.col("__n")), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
    return joined.select(*left.columns, value.alias(mark))


def mark_exists(left: DataFrame, right: DataFrame, pairs, mark: str = "mark") -> DataFrame:
    """``left`` with ``mark``: does a row with equal keys exist? Never null."""
    seen = right.select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(pairs)]).distinct().withColumn("__hit", F.lit(True))
    on = reduce(Column.__and__, [F.col(a) == F.col(f"__k{i}") for i, (a, _) in enumerate(pairs)])
    return left.join(seen, on, "left").select(*left.columns, F.coalesce("__hit", F.lit(False)).alias(mark))


def asof_join(left: DataFrame, right: DataFrame, on: tuple[str, str], by=(), columns=(), how: str = "inner") -> DataFrame:
    """Each left row with ``columns`` of the right row of the same ``by`` keys whose time is the latest at or before its own.

    Both sides are united and sorted once per key, and the last right row is
    carried forward: one shuffle, and no pairs. With equal times on the right,
    one with the greatest columns is taken. Without ``by`` all rows form one
    sequence in one task; give keys where the input is large.
    """
    t_left, t_right = on
    carried = F.struct(*[F.col(c) for c in (t_right, *columns)])
    l_rows = left.select(*[F.col(a).alias(f"__k{i}") for i, (a, _) in enumerate(by)], F.col(t_left).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).alias("__right"))
    r_rows = right.where(F.col(t_right).isNotNull()).select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(by)], F.col(t_right).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__left"), carried.alias("__right"))
    keys = [f"__k{i}" for i in range(len(by))]
    w = Window.partitionBy(*keys).orderBy(F.col("__t").asc_nulls_first(), "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
    # No left row has a null key or time that matches anything.
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.col("__t").isNotNull())
    found = l_rows.unionByName(r_rows).withColumn("__match", F.when(known, F.last("__right", ignorenulls=True).over(w))).where("__side = 1")
    if how == "inner":
        found = found.where("__match IS NOT NULL")
    return found.select("__left.*", *[F.col(f"__match.{c}").alias(c) for c in (t_right, *columns)])


def positional_join(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Rows of equal position in the given orders side by side; the shorter side is padded."""
    l_rows, r_rows = numbered(left, left_order, "__p"), numbered(right, right_order, "__q")
    return l_rows.join(r_rows, F.col("__p") == F.col("__q"), "full").drop("__p", "__q")


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """Adds each row's place in the total order, from 0, without sorting in one task.

    Rows are sorted by ranges; each partition is numbered by itself, and the
    counts of the partitions before it are added. The sorted rows are written
    first: both steps see the same partitions, even if an executor is lost.
    """
    ordered = df.orderBy(*order).withColumn("__mono", F.monotonically_increasing_id())
    placed = ordered.withColumns({"__part": F.shiftright("__mono", 33), "__at": F.col("__mono").bitwiseAND((1 << 33) - 1)})
    placed = cut_lineage(placed)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__part").alias("__p2"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = placed.join(F.broadcast(before), F.col("__part") == F.col("__p2"))
    return out.withColumn(name, F.col("__before") + F.col("__at")).drop("__mono", "__part", "__at", "__p2", "__before")


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, pairs=()) -> DataFrame:
    """Pairs with ``right_value`` within ``width`` of ``left_value``, and equal keys.

    Values are put in bins of that width; a left row visits its bin and the two
    beside it, so the join is on equal bins and is shuffled, not nested.
    """
    bins = F.floor(F.col(left_value) / width)
    l_rows = left.withColumn("__bin", F.explode(F.array(bins - 1, bins, bins + 1)))
    r_rows = right.withColumn("__bin2", F.floor(F.col(right_value) / width))
    on = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in pairs], F.col("__bin") == F.col("__bin2"))
    near = F.abs(F.col(left_value) - F.col(right_value)) <= width
    return l_rows.join(r_rows, on & near).drop("__bin", "__bin2")


def salted_join(left: DataFrame, right: DataFrame, pairs, salts: int, how: str = "inner") -> DataFrame:
    """A join whose hot left keys are dealt to ``salts`` tasks; the right side is repeated that often.

    For inner, left and left semi or anti joins. Adaptive execution splits skewed
    partitions by itself where it can; this is for plans in which it can't.

    Both sides are shuffled and sorted, which spills. The repeated side is never
    broadcast: the planner's estimate has its size before it is repeated, and
    each task would hold all of it.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the right side is repeated: only inner and left joins")
    l_rows = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    r_rows = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = keys_equal(l_rows, r_rows, pairs) & (F.col("__salt") == F.col("__salt2"))
    return l_rows.join(r_rows.hint("merge"), on, how).drop("__salt", "__salt2")
