"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step, written: link neighbours with the smallest node around.

    The large star moves the neighbours above a node, the small star those
    below it and the node itself. Neighbour lists are never gathered: the
    smallest neighbour is found by an aggregation and joined back.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    out = materialize(out.where(F.col("a") != F.col("b")).distinct(), "star")
    discard(least, edges)
    return out


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of each end of a link; materialized.

    ``links``: columns a and b of one ordered type; nulls and self-links are
    ignored. Large and small stars alternate until nothing changes; both keep
    the components, and the links end as stars around the smallest nodes. Each
    round is written to the shared folder, and replaces the one before.
    """
    edges = links.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = _star(_star(edges, True), False)
        # Stars: no centre is itself linked to something smaller, and the sum of the links no longer falls.
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components didn't settle")
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    centres = edges.select(F.col("b").alias("node")).distinct()
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))
    out = materialize(out, "components")
    discard(edges)
    return out
