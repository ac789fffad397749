"""Where results go: files, tables, and the driver in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by=(), rows_per_file: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet files, in a folder per value of the partition columns.

    Rows are dealt by the partition columns, and adaptive execution splits a
    large folder among tasks by its size and lets small ones share a task;
    ``rows_per_file`` cuts files.
    """
    out = df
    if partition_by:
        out = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = out.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_bucketed(df: DataFrame, table: str, keys, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """A table whose rows are dealt and sorted by ``keys``: joins and group-bys over the keys need no shuffle."""
    df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def append(spark: SparkSession, df: DataFrame, table: str) -> None:
    """INSERT INTO by column names."""
    df.select(*spark.table(table).columns).write.insertInto(table)


def arrow_batches(df: DataFrame, max_rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches of ``max_rows``, one partition on the driver at a time; tasks make the batches."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as stream:
                    stream.write_batch(batch.slice(at, max_rows))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["data"])

    held, n = [], 0
    for row in df.mapInArrow(pack, "data binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(row["data"]) as stream:
            held += stream
        n = sum(b.num_rows for b in held)
        while n >= max_rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, max_rows).combine_chunks().to_batches()[0]
            held, n = table.slice(max_rows).to_batches(), n - max_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
