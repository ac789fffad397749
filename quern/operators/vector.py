"""Nearest neighbours: exact, and through an inverted file of k-means cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("l2", "cosine")
#: Rows that the cells' centres are fitted on at most.
FIT_ROWS = 50_000
MOST_LISTS = 1024
#: Held-back queries by which the number of probes is chosen, and the recall that it shall reach on them.
HELD_BACK, NEIGHBOURS, RECALL = 100, 10, 0.97
#: An index is dealt to about so many shards, of so many rows at least and at most.
SHARDS, SHARD_ROWS = 128, (1024, 65_536)
#: Queries that meet a shard at once, and distances that a task holds at once.
ASKED_ROWS, HELD_DISTANCES = 65_536, 1 << 22


def _doubles(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: Column, metric: str = "l2") -> Column:
    """Euclidean distance, or 1 - cosine; null for a null vector or one of another length."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    v = vector.cast("array<double>")
    if metric == "l2":
        d = F.sqrt(F.aggregate(F.zip_with(v, query, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    else:
        norms = F.sqrt(_dot(v, v)) * F.sqrt(_dot(query, query))
        d = F.when(norms > 0, 1 - _dot(v, query) / norms)
    return F.when(F.size(v) == F.size(query), d)


def knn_search(df: DataFrame, column: str, query: Sequence[float], k: int = 10, metric: str = "l2", output=None, tie: str | None = None) -> DataFrame:
    """The k nearest rows with a float ``distance``, nearest first; equal distances by ``tie``.

    One pass, in which each task keeps k rows. Rows without a distance are left out.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    names = list(output or df.columns)
    d = df.withColumn("__d", distance(F.col(column), _doubles(query), metric)).where("__d IS NOT NULL")
    order = [F.col("__d")] + ([F.col(tie)] if tie else [])
    return d.orderBy(*order).limit(k).select(*names, F.col("__d").cast("float").alias("distance"))


def knn_join(queries: DataFrame, df: DataFrame, query_id: str, query: str, row_id: str, column: str, k: int, metric: str = "l2", block: int = 256) -> DataFrame:
    """The k nearest rows for each of a bounded set of queries: query_id, row_id, distance, rank.

    The queries go to all tasks and are compared with the rows in blocks, by a
    matrix product; each task passes on its k best of each query.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    rows = queries.select(query_id, query).where(F.col(query).isNotNull()).orderBy(query_id).collect()
    ids = np.array([r[0] for r in rows], np.int64)
    q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)

    def best(batches):
        near, far = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
        for pdf in batches:
            pdf = pdf[pdf["v"].notna()]
            if not len(pdf) or not len(ids):
                continue
            x, own = np.array(pdf["v"].tolist(), np.float64), pdf["i"].to_numpy()
            parts = []
            for at in range(0, len(ids), block):
                part = q[at : at + block]
                if metric == "l2":
                    d = np.sqrt(np.maximum((part**2).sum(1)[:, None] - 2 * part @ x.T + (x**2).sum(1)[None], 0))
                else:
                    d = 1 - (part @ x.T) / (np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
                pick = np.argsort(d, axis=1, kind="stable")[:, :k]
                parts.append((own[pick], np.take_along_axis(d, pick, 1)))
            near = np.concatenate([near, np.concatenate([p[0] for p in parts])], axis=1)
            far = np.concatenate([far, np.concatenate([p[1] for p in parts])], axis=1)
            order = np.lexsort((near, far), axis=1)[:, :k]
            near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        yield pd.DataFrame({query_id: np.repeat(ids, near.shape[1]), row_id: near.ravel(), "distance": far.ravel()})

    found = df.select(F.col(row_id).alias("i"), F.col(column).alias("v")).mapInPandas(best, f"{query_id} long, {row_id} long, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("distance", row_id)))
    return ranked.where(F.col("rank") <= k)


class VectorIndexes:
    """Inverted-file indexes: rows are kept with the cell of their nearest centre.

    Centres are fitted by seeded k-means on a bounded sample; every row is
    indexed. A search reads the ``n_probes`` cells nearest to the query. Their
    default is measured when the index is made: exact neighbours of held-back
    queries are looked up in all rows, and so many cells are probed as held the
    share ``RECALL`` of them, however many rows and cells there are.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._held = spark, {}

    def create(self, name: str, df: DataFrame, column: str, metric: str = "l2", n_lists: int | None = None, seed: int = 42) -> None:
        if metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}")
        if name in self._held:
            raise ValueError(f"there is an index {name} already")
        sound = df.where(F.col(column).isNotNull())
        n = sound.count()
        lists = min(max(n_lists or int(n**0.5), 1), MOST_LISTS, max(n, 1))
        points = np.array([r[0] for r in _fit_rows(sound, column, n, seed)], np.float64)
        centres = _centres(_scaled(points, metric), lists, seed) if len(points) else np.zeros((1, 1))

        def assign(batches):
            import pyarrow as pa

            for batch in batches:
                x = _matrix(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(_scaled(x, metric), centres)), *batch.columns[1:]], names=["__list", *batch.schema.names[1:]])

        kept = sound.select(F.col(column).alias("__v"), *df.columns)
        schema = "__list long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        assigned = kept.mapInArrow(assign, schema).persist()
        probes = _probes_for(assigned, centres, column, metric, seed) if len(points) else 1
        sizes = dict(map(tuple, assigned.groupBy("__list").count().collect()))
        shards = _shards(sizes, len(centres), min(max(n // SHARDS, SHARD_ROWS[0]), SHARD_ROWS[1]))
        self._held[name] = (assigned, centres, column, metric, df.columns, probes, shards)

    def probes(self, name: str) -> int:
        """The number of cells that a search of this index reads unless it is told."""
        return self._held[name][5]

    def search_all(self, name: str, queries: DataFrame, query_id: str, query: str, row_id: str, k: int = 10) -> DataFrame:
        """query_id, row_id and distance of up to k rows for each row of ``queries``, however many there are.

        Rows lie in shards of a few small cells or a part of a large one. A query
        goes once to each shard that has some of its cells, and is compared with
        their rows by matrix products; each shard passes on its k best. Neither
        side is collected, and no shard or block of queries grows with the table.
        """
        rows, centres, column, metric, _, probes, (first, parts) = self._held[name]
        spark = rows.sparkSession

        def deal(batches):
            import pyarrow as pa

            for batch in batches:
                for start in range(0, len(batch), 512):
                    part = batch.slice(start, 512)
                    near = _ranked_cells(_scaled(_matrix(part.column("q")), metric), centres)[:, :probes]
                    times = parts[near.ravel()]
                    cell = np.repeat(near.ravel(), times)
                    shard = np.repeat(first[near.ravel()], times) + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                    at = np.repeat(np.repeat(np.arange(len(part)), near.shape[1]), times)
                    order = np.lexsort((shard, at))
                    at, shard, cell = at[order], shard[order], cell[order]
                    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (shard[1:] != shard[:-1])])
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[new, len(cell)], pa.int32()), pa.array(cell, pa.int32()))
                    asked = [part.column(c).take(pa.array(at[new])) for c in ("__q", "q")]
                    yield pa.RecordBatch.from_arrays([*asked, pa.array(shard[new], pa.int32()), cells], names=["__q", "q", "__shard", "__cells"])

        whole = queries.where(F.col(query).isNotNull() & F.forall(query, lambda x: x.isNotNull()))
        blocks = -(-max(whole.count(), 1) // ASKED_ROWS)
        asked = whole.select(F.col(query_id).cast("long").alias("__q"), F.col(query).cast("array<double>").alias("q"))
        asked = asked.mapInArrow(deal, "__q long, q array<double>, __shard int, __cells array<int>").withColumn("__block", F.pmod(F.xxhash64("__q"), F.lit(blocks)))
        placed = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, parts))], "__list long, __first int, __parts int")
        placed = rows.where(F.forall(column, lambda x: x.isNotNull())).join(F.broadcast(placed), "__list")
        shard = (F.col("__first") + F.pmod(F.xxhash64(row_id), F.col("__parts"))).cast("int")
        placed = placed.select(shard.alias("__shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__block"), "__list", F.col(row_id).alias("__r"), F.col(column).alias("v"))

        def best(held, come):
            return _best_of_shard(held, come, k, metric)

        both = placed.groupBy("__shard", "__block").cogroup(asked.groupBy("__shard", "__block"))
        found = both.applyInArrow(best, f"__q long, __r {rows.schema[row_id].dataType.simpleString()}, d double")
        rank = F.row_number().over(Window.partitionBy("__q").orderBy("d", "__r"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("__q").alias(query_id), F.col("__r").alias(row_id), F.col("d").alias("distance"))

    def search(self, name: str, query: Sequence[float], k: int = 10, n_probes: int | None = None, tie: str | None = None) -> DataFrame:
        """Up to k rows of the probed cells; fewer are possible."""
        if name not in self._held:
            raise KeyError(f"no index {name}")
        rows, centres, column, metric, columns, probes, _ = self._held[name]
        q = _scaled(np.array([query], np.float64), metric)
        near = _ranked_cells(q, centres)[0, : n_probes or probes]
        return knn_search(rows.where(F.col("__list").isin(near.tolist())), column, query, k, metric, columns, tie)

    def drop(self, name: str) -> None:
        if name not in self._held:
            raise KeyError(f"no index {name}")
        self._held.pop(name)[0].unpersist()


def _fit_rows(sound: DataFrame, column: str, n: int, seed: int) -> list:
    """Up to FIT_ROWS of n vectors, those of the least hashes.

    Each task sends the driver so many rows as are asked for. Of large tables
    only hashes below a cut are sorted, which twice as many rows have; copies
    share a hash, and if too few are below it, all are sorted.
    """
    hashed = sound.select(column, F.xxhash64(column, F.lit(seed)).alias("__h"))
    if n > 4 * FIT_ROWS:
        cut = (2 * FIT_ROWS << 64) // n - (1 << 63)
        found = hashed.where(F.col("__h") < cut).orderBy("__h").limit(FIT_ROWS).collect()
        if len(found) == FIT_ROWS:
            return found
    return hashed.orderBy("__h").limit(FIT_ROWS).collect()


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow column in double precision, one per row; null components become NaN."""
    import pyarrow.compute as pc

    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors differ in length")
    return np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _shards(sizes: dict[int, int], lists: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each cell and the number of its shards, so that a shard has about ``most`` rows at most.

    Small cells in a row share a shard; a larger cell is dealt to several of its own.
    """
    first, parts, shard, filled = [], [], 0, 0
    for cell in range(lists):
        size = sizes.get(cell, 0)
        if filled and filled + size > most:
            shard, filled = shard + 1, 0
        first.append(shard)
        parts.append(max(-(-size // most), 1))
        shard, filled = (shard + parts[-1], 0) if parts[-1] > 1 else (shard, filled + size)
    return np.array(first), np.array(parts)


def _best_of_shard(held, come, k: int, metric: str):
    """Up to k rows of a shard for each query, among the rows of its cells: Arrow tables of rows and queries.

    Matrix products choose the candidates, with a margin above their rounding;
    the candidates' distances are then summed as ``distance`` does.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, come = held.combine_chunks(), come.combine_chunks()
    out = pa.schema([("__q", pa.int64()), ("__r", held.schema.field("__r").type), ("d", pa.float64())])
    if not len(held) or not len(come):
        return out.empty_table()
    held = held.take(pc.sort_indices(held["__r"], null_placement="at_start"))
    cell, x = held["__list"].to_numpy(), _matrix(held["v"].combine_chunks())
    # Of equal vectors the k smallest ids are enough.
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    copy = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    ids = np.sort(order[copy < k])
    ids = ids[np.argsort(cell[ids], kind="stable")]
    cell, x, q = cell[ids], x[ids], _matrix(come["q"].combine_chunks())
    cells, begin = np.unique(cell, return_index=True)
    end = np.r_[begin[1:], len(cell)]
    lists = come["__cells"].combine_chunks()
    wanted, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy())
    place = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    here = cells[place] == wanted
    hit = np.zeros((len(q), len(cells)), bool)
    hit[at[here], place[here]] = True
    with np.errstate(all="ignore"):
        xs, qs = _scaled(x, metric), _scaled(q, metric)
        xx, qq = (xs**2).sum(1), (qs**2).sum(1)
        # Where squares leave the range of doubles, each pair is a candidate.
        x_sound, q_sound = ((v**2).sum(1) < 1e200 for v in (x, q))
        if metric == "cosine":
            x_sound, q_sound = x_sound & ((x**2).sum(1) > 1e-200), q_sound & ((q**2).sum(1) > 1e-200)
        margin = 1e-12 * (qq + xx[x_sound].max(initial=0)) + 1e-300
        step, last = max(HELD_DISTANCES // len(x), 1), np.finfo(np.float64).max
        found = []
        for start in range(0, len(q), step):
            some = slice(start, start + step)
            near = np.full((len(q[some]), len(x)), np.inf)
            for j, (a, z) in enumerate(zip(begin, end)):
                ask = np.flatnonzero(hit[some, j])
                if len(ask):
                    d = qq[some][ask, None] - 2 * qs[some][ask] @ xs[a:z].T + xx[None, a:z]
                    d[:, ~x_sound[a:z]], d[~q_sound[some][ask]] = last, last
                    near[ask, a:z] = d
            limit = np.partition(near, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(near), np.inf)
            limit = np.where(limit < last, limit + margin[some], last)
            row, col = np.nonzero((near <= limit[:, None]) | (near == last))
            row += start
            d = np.concatenate([_exact(q[row[b : b + 65_536]], x[col[b : b + 65_536]], metric) for b in range(0, max(len(row), 1), 65_536)])
            row, rank, d = (v[~np.isneginf(d)] for v in (row, ids[col], d))
            order = np.lexsort((rank, d, row))
            row, rank, d = row[order], rank[order], d[order]
            starts = np.flatnonzero(np.r_[True, np.diff(row) != 0][: len(row)])
            keep = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) < k
            found.append((row[keep], rank[keep], d[keep]))
    row, rank, d = (np.concatenate(v) for v in zip(*found))
    return pa.table([come["__q"].take(pa.array(row)), held["__r"].take(pa.array(rank)), pa.array(d)], schema=out)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs, summed from the first component to the last; -inf where there is none."""

    def total(terms):
        s = np.zeros(len(terms))
        for j in range(terms.shape[1]):
            s += terms[:, j]
        return s

    if metric == "l2":
        return np.sqrt(total((x - q) * (x - q)))
    norms = np.sqrt(total(x * x)) * np.sqrt(total(q * q))
    return np.where(norms == 0, -np.inf, 1 - total(x * q) / norms)


def _ranked_cells(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """All cells for each query, the nearest first."""
    return np.argsort((centres**2).sum(1)[None] - 2 * q @ centres.T, axis=1, kind="stable")


def _probes_for(rows: DataFrame, centres: np.ndarray, column: str, metric: str, seed: int) -> int:
    """How many cells hold the share RECALL of the exact neighbours of held-back queries."""
    held = rows.select(column).orderBy(F.xxhash64(column, F.lit(seed + 1))).limit(HELD_BACK).collect()
    queries = [(k, [float(x) for x in r[0]]) for k, r in enumerate(held)]
    asked = rows.sparkSession.createDataFrame(queries, "__q long, q array<double>")
    # The cell of each neighbour stands for its id; the nearest one is the query itself.
    exact = knn_join(asked, rows, "__q", "q", "__list", column, NEIGHBOURS + 1, metric).where("rank > 1").select("__q", "__list").collect()
    ranked = np.argsort(_ranked_cells(_scaled(np.array([q for _, q in queries]), metric), centres), axis=1, kind="stable")
    at = np.sort([ranked[r["__q"], r["__list"]] for r in exact])
    return int(at[int(np.ceil(RECALL * len(at))) - 1]) + 1 if len(at) else len(centres)


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return x
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    own, c = np.empty(len(x), np.int64), (centres**2).sum(1)[None]
    for at in range(0, len(x), 8192):
        own[at : at + 8192] = np.argmin(c - 2 * x[at : at + 8192] @ centres.T, axis=1)
    return own


def _centres(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=n)
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], n)
            centres[count > 0, d] = total[count > 0] / count[count > 0]
    return centres
