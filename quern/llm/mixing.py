"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; its documents begin with one fractional
number of copies, target over size. Whole copies are granted, and what is left
of each document, a probability p, is rounded by pivots: two documents with
sizes a and b trade mass, a*dp = -b*dq, until one of the probabilities is 0 or
1. The direction is drawn so that no expectation changes, and the words of the
two together stay the same, so that a source ends near its target whatever its
size.

The pivots form a reduction tree. Documents of a source are dealt by a hash of
their key into buckets of about ``FAN_IN``; each bucket is rounded on its own
and passes on at most one document that is still fractional; ``FAN_IN``
buckets meet on the next level, until one document of the source is left, and
that is rounded to the nearer side, which keeps the source within half of that
document of its target. No step holds more than a bucket.

Every draw is a hash of the document's key and the level, so reruns agree.
Rows that agree in id, source and size share a key; they are counted first and
told apart by an ordinal, and so may get different numbers of copies.

Defined results: a null text has size 0; documents without words take no words
and keep one copy; a null source is a source of its own and comes last; in an
empty table nothing is mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACE_RUN, broadcast_if_small, let, materialize, table, whole_row

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
FAN_IN = 128
SEED = 42


def word_count(text: Column) -> Column:
    """Number of words: runs of anything but ASCII white space."""
    t = F.coalesce(text, F.lit(""))
    edges = F.regexp_replace(t, rf"^{SPACE_RUN}|{SPACE_RUN}$", "")
    return F.when(edges == "", F.lit(0)).otherwise(F.size(F.split(edges, SPACE_RUN))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, n_docs and target in words.

    ``share`` of all words is dealt by weight; a source takes at most ``most``
    times its size, and what it can't take goes to the others by weight. The
    level at which that ends is found at once: sources are ordered by the
    level at which they are full, and the first one whose level isn't reached
    by what the ones before leave over ends the search. The windows run over
    one row per source, not over documents.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    own = materialize(own, "sources")
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    own = own.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    own = own.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    own = own.withColumn("taken_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    own = own.withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    total = share * F.sum("source_size").over(every)
    own = own.withColumn("level", (total - F.col("taken_before")) / F.col("weight_left"))
    # Levels rise while sources fill up and fall after the first unfilled one, which so has the largest.
    reached = F.max(F.when(F.col("level") < F.col("full_at"), F.col("level"))).over(every)
    target = F.when(reached.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), reached * F.col("weight")))
    return own.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.call_function("shiftrightunsigned", F.xxhash64(*parts), F.lit(12)) + 0.5) / float(1 << 52)


def _pivot(a: Column, b: Column) -> Column:
    """The struct (left, done): a after its trade with b, both ways of who stays fractional."""
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["large"].alias("large"), x["key"].alias("key"), x["size"].alias("size"), x["draw"].alias("draw"), p.alias("p"))

    def settle(q: Column) -> Column:
        # q: (pa, pb); exactly the one that hit its bound is done
        x, y = with_p(a, q["pa"]), with_p(b, q["pb"])
        return F.when((q["pa"] <= 0) | (q["pa"] >= 1), F.struct(y.alias("left"), x.alias("done"))).otherwise(F.struct(x.alias("left"), y.alias("done")))

    def bounds(rise: Column) -> Column:
        mass = F.when(rise, up).otherwise(down)
        sign = F.when(rise, F.lit(1.0)).otherwise(F.lit(-1.0))
        pa, pb = a["p"] + sign * mass / a["size"], b["p"] - sign * mass / b["size"]
        a_ends = F.when(rise, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
        b_ends = F.when(rise, (1 - a["p"]) * a["size"] >= b["p"] * b["size"]).otherwise(a["p"] * a["size"] >= (1 - b["p"]) * b["size"])
        pa = F.when(a_ends, F.when(rise, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(pa)
        pb = F.when(b_ends, F.when(rise, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(pb)
        return F.struct(pa.alias("pa"), pb.alias("pb"))

    return let(let(b["draw"] * (up + down) < down, bounds), settle)


ITEM = "struct<large:double,key:struct<doc_id:bigint,nth:bigint,source:string,size:bigint>,size:double,draw:double,p:double>"


def _round_bucket(items: Column) -> Column:
    """Fold the items of a bucket, larger ones first: (left, done), left null when all are integral.

    Neighbours are of like size then, so either may be done first, and what is
    left at the end tends to be small.
    """

    def integral(x: Column) -> Column:
        return (x["p"] <= 0) | (x["p"] >= 1)

    def add(state: Column, x: Column) -> Column:
        def traded(r: Column) -> Column:
            left = F.when(~integral(r["left"]), r["left"])
            done = F.concat(state["done"], F.array(r["done"]), F.when(integral(r["left"]), F.array(r["left"])).otherwise(F.array().cast(f"array<{ITEM}>")))
            return F.struct(left.alias("left"), done.alias("done"))

        return F.when(state["left"].isNull(), F.struct(x.alias("left"), state["done"].alias("done"))).otherwise(let(_pivot(state["left"], x), traded))

    empty = F.struct(F.lit(None).cast(ITEM).alias("left"), F.array().cast(f"array<{ITEM}>").alias("done"))
    return F.aggregate(F.array_sort(items), empty, add)


def pivotal_copies(parts: DataFrame, fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """Round the fractional part ``p`` of each row to 0 or 1: adds ``extra`` int.

    ``parts``: key struct, source, size long over 0, p double with 0 < p < 1,
    n_docs of the source. Returns key and extra.
    """
    n_buckets = F.greatest(F.ceil(F.col("n_docs") / fan_in), F.lit(1))
    items = parts.select(
        "source",
        F.pmod(F.xxhash64(F.lit(seed), "key"), n_buckets).alias("bucket"),
        F.struct((-F.col("size").cast("double")).alias("large"), F.col("key"), F.col("size").cast("double").alias("size"), _uniform(F.lit(seed + 1), F.col("key")).alias("draw"), F.col("p").alias("p")).alias("item"),
    )
    levels = 1
    most = parts.agg(F.max(n_buckets)).first()[0] or 1
    while most > 1:
        levels, most = levels + 1, -(-most // fan_in)
    decided = []
    for level in range(levels):
        rounded = items.groupBy("source", "bucket").agg(_round_bucket(F.collect_list("item")).alias("r"))
        rounded = materialize(rounded.select("source", "bucket", "r.left", "r.done"), "pivots")
        decided.append(rounded.select(F.explode("done").alias("x")).select("x.key", F.round("x.p").cast("int").alias("extra")))
        drawn = F.struct(F.col("left.large").alias("large"), F.col("left.key").alias("key"), F.col("left.size").alias("size"), _uniform(F.lit(seed + 2 + level), F.col("left.key")).alias("draw"), F.col("left.p").alias("p"))
        items = rounded.where(F.col("left").isNotNull()).select("source", F.floor(F.col("bucket") / fan_in).alias("bucket"), drawn.alias("item"))
    decided.append(items.select("item.key", F.when(F.col("item.p") >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("extra")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES, doc_id: str = "doc_id", text: str = "text", source: str = "source", fan_in: int = FAN_IN, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of ``docs``."""
    sizes = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    counted = materialize(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    rows = counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("nth"))
    targets = materialize(source_targets(rows, weights, share, most), "targets")
    side = targets.withColumnRenamed("source", "__source")
    rows = rows.join(broadcast_if_small(side), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.col("target") / F.col("source_size")
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.floor(rate), F.lit(most)).cast("int"))
    key = F.struct("doc_id", "nth", "source", "size")
    rows = rows.select(key.alias("key"), "source", "size", "n_docs", "source_size", "target", whole.alias("whole"), F.when(F.col("size") > 0, rate - F.least(F.floor(rate), F.lit(most))).otherwise(F.lit(0.0)).alias("p"))
    fractional = rows.where((F.col("p") > 0) & (F.col("p") < 1))
    extra = pivotal_copies(fractional.select("key", "source", "size", "n_docs", "p"), fan_in, seed)
    done = extra.unionByName(rows.where(~((F.col("p") > 0) & (F.col("p") < 1))).select("key", F.lit(0).alias("extra")))
    done = done.select("key.*", "extra").join(broadcast_if_small(side), F.col("source").eqNullSafe(F.col("__source")), "left")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.floor(rate), F.lit(most)).cast("int")) + F.col("extra")
    return done.select("doc_id", "source", "nth", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    copies = materialize(mix(docs, doc_id=doc_id, text=text, source=source, **params).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("nth").alias("__nth"), "copies"), "copies")
    rows = docs.select(whole_row(docs).alias("__row"), F.col(doc_id).cast("long").alias("__rid"), F.col(source).alias("__rsource"), word_count(F.col(text)).alias("__rsize"))
    several = copies.where("__nth > 1").select("__id", "__source", "__size").distinct()
    same = F.col("__rid").eqNullSafe(F.col("__id")) & F.col("__rsource").eqNullSafe(F.col("__source")) & F.col("__rsize").eqNullSafe(F.col("__size"))
    several = materialize(several, "several")
    if several.isEmpty():
        numbered = rows.withColumn("__rnth", F.lit(1).cast("long"))
    else:
        # Only rows that agree in id, source and size need an order of their own.
        marked = rows.join(several.withColumn("__many", F.lit(True)), same, "left").drop("__id", "__source", "__size")
        order = Window.partitionBy("__rid", "__rsource", "__rsize").orderBy(F.xxhash64("__row"))
        numbered = marked.where("__many").drop("__many").withColumn("__rnth", F.row_number().over(order).cast("long"))
        numbered = numbered.unionByName(marked.where("__many IS NULL").drop("__many").withColumn("__rnth", F.lit(1).cast("long")))
    out = numbered.join(copies, same & (F.col("__rnth") == F.col("__nth")), "left")
    out = out.where(F.coalesce("copies", F.lit(0)) > 0).select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return out.select("__row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: 150% of their words at weights 5, 2, 1."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
