"""Embedding near-dedup: p-stable Euclidean hashing and exact cosine checks.

Equal vectors of a label are one class, so a group of copies is one row
however large it is. Class vectors are normalised, and each of ``TABLES``
tables hashes a vector by ``WIDTH`` quantised random projections: floor((a.x +
b) / w) with normal a. Vectors of one label that share a bucket of a table are
compared exactly, by their cosine in double precision.

At a cosine of 0.93 two unit vectors are 0.374 apart, and one projection of
width 1.5 agrees with probability 0.80; five agree with 0.33, so the twenty
tables together miss such a pair with probability 0.0003; closer pairs are
missed less often. Vectors at a right angle share a bucket of a table with
probability 0.009.

A pair that shares the buckets of several tables counts in the first of them,
which both sides see from their signatures, so nothing is emitted per pair: a
task gives the number of links of each class, and a spanning forest. A bucket
of over ``block`` classes is cut into blocks by a hash; each pair of blocks is
a task's group of its own, with at most twice that many rows.

Defined results: vectors that are null, empty or zero, that hold nulls or
numbers that aren't finite, or that have no label link with nothing and are
their own component; vectors of different lengths are never linked. Repeated
ids are linked like others and get one row each. A null id names a component
only if it has no other. An empty table gives no rows; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, quoted, table
from quern.llm.components import connected_components
from quern.llm.simhash import spanning_forest

MIN_COSINE = 0.93
TABLES = 20
WIDTH = 5
CELL = 1.5
BLOCK = 4096
#: Rows of small buckets that share a group, about.
GROUP_ROWS = 20_000
SEED = 42
KEPT_TYPES = {"array<float>": "array<float>"}
#: Rows of a slab of the cosine matrix: bounds memory.
SLAB = 1024


def projections(dim: int, tables: int = TABLES, width: int = WIDTH, cell: float = CELL, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The normal directions (dim, tables * width) and offsets for one dimension."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * width)), rng.uniform(0, cell, tables * width)


def signatures(unit: np.ndarray, tables: int = TABLES, width: int = WIDTH, cell: float = CELL, seed: int = SEED) -> np.ndarray:
    """One 32-bit number per row and table, of the quantised projections."""
    a, b = projections(unit.shape[1], tables, width, cell, seed)
    cells = np.floor((unit @ a + b) / cell).astype(np.int64).reshape(len(unit), tables, width)
    out = np.zeros((len(unit), tables), np.int64)
    for k in range(width):
        out = out * 1024 + (cells[:, :, k] + 512)
    # 32 bits of it name the bucket: two quantised places that share a name are one bucket.
    out = out.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(tables, width, cell, seed):
    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            out = np.zeros((len(pdf), tables), np.int32)
            for dim, rows in pdf.groupby(pdf["vec"].map(len)).groups.items():
                out[rows] = signatures(_unit(pdf["vec"][rows].tolist()), tables, width, cell, seed)
            yield pdf.assign(sigs=list(out))

    return run


def _compare(min_cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for (_, _, t, _, lo, hi), rows in pdf.groupby(["label", pdf["vec"].map(len), "t", "bucket", "lo", "hi"], sort=False):
            n = len(rows)
            if n < 2:
                continue
            x = _unit(rows["vec"].tolist())
            before = np.stack(rows["sigs"].to_numpy())[:, :t]
            blk, cls, m = rows["blk"].to_numpy(), rows["class_id"].to_numpy(), rows["m"].to_numpy()
            links, edges_a, edges_b = np.zeros(n, np.int64), [], []
            for at in range(0, n, SLAB):
                i, j = np.nonzero(x[at : at + SLAB] @ x.T >= min_cosine)
                i = i + at
                good = i < j
                if lo != hi:
                    good &= blk[i] != blk[j]
                i, j = i[good], j[good]
                for k in range(t):
                    fresh = before[i, k] != before[j, k]
                    i, j = i[fresh], j[fresh]
                np.add.at(links, i, m[j])
                np.add.at(links, j, m[i])
                a, b = spanning_forest(n, i, j)
                edges_a.append(a)
                edges_b.append(b)
            a, b = spanning_forest(n, np.concatenate(edges_a), np.concatenate(edges_b))
            near = np.arange(n)
            near[a] = b
            some = (links > 0) | (near != np.arange(n))
            parts.append(pd.DataFrame({"class_id": cls[some], "n": links[some], "near": cls[near[some]]}))
        return pd.concat(parts) if parts else pd.DataFrame({"class_id": np.empty(0, np.int64), "n": np.empty(0, np.int64), "near": np.empty(0, np.int64)})

    return run


def class_links(classes: DataFrame, min_cosine: float = MIN_COSINE, tables: int = TABLES, width: int = WIDTH, cell: float = CELL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """class_id, n (vectors in linked classes) and near (a class it is connected with).

    ``classes``: class_id, label, vec (of finite numbers, not all zero) and m
    (vectors in the class), materialized. One class may have several rows.
    """
    hashed = classes.mapInPandas(_hashed(tables, width, cell, seed), f"class_id long, label int, vec {classes.schema['vec'].dataType.simpleString()}, m long, sigs array<int>")
    hashed = materialize(hashed, "signed")
    keyed = hashed.select("*", F.posexplode("sigs").alias("t", "bucket"))
    key = ["label", "t", "bucket"]
    # The sizes of the buckets need no vectors; buckets of one class are done.
    sizes = hashed.select("label", F.posexplode("sigs").alias("t", "bucket")).groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialize(sizes.select(F.col("label").alias("__l"), F.col("t").alias("__t"), F.col("bucket").alias("__b"), "size", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "buckets")
    same = (F.col("label") == F.col("__l")) & (F.col("t") == F.col("__t")) & (F.col("bucket") == F.col("__b"))
    shared = keyed.join(sizes, same).drop("__l", "__t", "__b", "size")
    shared = shared.withColumn("blk", F.pmod(F.xxhash64("class_id", F.lit(seed)), F.col("blocks")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.select("class_id", "label", "vec", "m", "sigs", "t", "bucket", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blocks")
    # Buckets with blocks go by pair of blocks, small ones share groups.
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4, total // GROUP_ROWS)
    part = F.when(F.col("blocks") > 1, F.xxhash64("label", "t", "bucket", "lo", "hi")).otherwise(F.pmod(F.xxhash64("label", "t", "bucket"), F.lit(parts)))
    found = shared.withColumn("part", part).drop("blocks").groupBy("part").applyInPandas(_compare(min_cosine), "class_id long, n long, near long")
    return found


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE, **params) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.col(quoted(label)).cast("int").alias("label"), F.col(quoted(embedding)).alias("vec"))
    # Single precision stays as it is, so that half as much is shuffled; it is widened before any sum.
    rows = rows.withColumn("vec", F.col("vec").cast(KEPT_TYPES.get(rows.schema["vec"].dataType.simpleString(), "array<double>")))
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = materialize(rows.withColumn("sound", sound), "vectors")
    good = rows.where("sound")
    own = good.groupBy(F.col("label").alias("label_"), F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("h2")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"))
    # A class is named by a number that it gets when the table is written, once: no two classes share one.
    own = materialize(own.withColumn("class_id", F.monotonically_increasing_id()).select("class_id", F.col("label_").alias("label"), "h", "h2", "vec", "m", "rep"), "classes")
    found = materialize(class_links(own.select("class_id", "label", "vec", "m"), min_cosine, **params), "near")
    counts = found.groupBy("class_id").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("class_id").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "__node")
    known = own.select("class_id", "label", "h", "h2", "rep", "m").join(counts, "class_id", "left").join(labels, F.col("class_id") == F.col("__node"), "left")
    known = materialize(known.select("label", "h", "h2", "rep", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("label_")), "known")
    least = known.groupBy("label_").agg(F.min("rep").alias("component_id"))
    known = materialize(known.join(least, "label_").select(F.col("label").alias("__label"), F.col("h").alias("__h"), F.col("h2").alias("__h2"), "n_links", "component_id"), "known")
    keyed = rows.where("sound").select("vec_id", "label", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    linked = keyed.join(known, [F.col(c) == F.col(f"__{c}") for c in ("label", "h", "h2")], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked within their label at a cosine of 0.93."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label: for small tables.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r(id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id
), c AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n_links FROM p GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a
"""
