"""Stream sessions with explicit ends and errors, and event-time streams.

A session has inputs that producers push DataFrames or rows to. Each push is a
set of Parquet files in the input's folder; a structured stream with the
``availableNow`` trigger carries what is there to the output and remembers in
its checkpoint what it has read, so a session that is opened again goes on.

An input ends when all its declared senders have closed; then it takes nothing
more. The first failure of a stream stays its error: later pushes and reads
raise it, and a failed stream never counts as ended.
"""

from __future__ import annotations

import enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Availability(enum.Enum):
    HAS_DATA = "has_data"
    WAITING = "waiting"
    END_OF_STREAM = "end_of_stream"


class StreamError(RuntimeError):
    """The first failure of a stream."""


class BatchStream:
    """One input: a folder of pushed batches and its senders."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, senders=("main",)):
        if not senders:
            raise ValueError("a stream has at least one sender")
        self._spark, self.folder, self.schema = spark, f"{folder.rstrip('/')}/in", schema
        self._checkpoint, self._out = f"{folder.rstrip('/')}/checkpoint", f"{folder.rstrip('/')}/out"
        self._open, self._senders, self._error = set(senders), set(senders), None
        self._pushed = self._drained = 0
        spark.createDataFrame([], schema).write.mode("append").parquet(self.folder)

    def _check(self) -> None:
        if self._error is not None:
            raise StreamError(self._error)

    def push(self, batch: DataFrame, sender: str = "main") -> None:
        self._check()
        if sender not in self._senders:
            raise ValueError(f"unknown sender {sender}")
        if sender not in self._open:
            raise ValueError(f"sender {sender} has closed")
        batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.mode("append").parquet(self.folder)
        self._pushed += 1

    def close(self, sender: str = "main") -> None:
        """Nothing more comes from this sender; closing again changes nothing."""
        self._check()
        if sender not in self._senders:
            raise ValueError(f"unknown sender {sender}")
        self._open.discard(sender)

    def fail(self, reason: str) -> None:
        """Only the first failure is kept."""
        if self._error is None:
            self._error = reason

    def availability(self) -> Availability:
        self._check()
        if self._pushed > self._drained:
            return Availability.HAS_DATA
        return Availability.WAITING if self._open else Availability.END_OF_STREAM

    def source(self) -> DataFrame:
        """The stream of what is pushed."""
        self._check()
        return self._spark.readStream.schema(self.schema).parquet(self.folder)

    def drain(self, transform=lambda df: df) -> DataFrame:
        """Carry what was pushed since the last call through ``transform``; all output so far.

        A failure of the query becomes the stream's error.
        """
        self._check()
        pushed = self._pushed
        out = transform(self.source())
        query = out.writeStream.format("parquet").option("path", self._out).option("checkpointLocation", self._checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            self.fail(str(e).splitlines()[0])
            raise StreamError(self._error) from e
        self._drained = pushed
        return self._spark.read.schema(out.schema).parquet(self._out)


class StreamSession:
    """Inputs by id, and outputs dealt by a hash of keys or to all."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._inputs = spark, folder.rstrip("/"), {}

    def declare(self, name: str, schema: StructType, senders=("main",)) -> BatchStream:
        if name in self._inputs:
            raise ValueError(f"{name} is declared already")
        self._inputs[name] = BatchStream(self._spark, f"{self._folder}/{name}", schema, senders)
        return self._inputs[name]

    def input(self, name: str) -> BatchStream:
        if name not in self._inputs:
            raise KeyError(f"no input {name}")
        return self._inputs[name]

    def drained(self) -> bool:
        """All inputs have ended and nothing is left to read."""
        return all(s.availability() is Availability.END_OF_STREAM for s in self._inputs.values())


def deal_by_hash(df: DataFrame, n: int, *keys: str) -> list[DataFrame]:
    """n disjoint parts; rows with equal keys are in one."""
    marked = df.withColumn("__to", F.pmod(F.xxhash64(*keys), F.lit(n)))
    return [marked.where(F.col("__to") == k).drop("__to") for k in range(n)]


def windowed(df: DataFrame, time: str, length: str, keys, aggregates, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Tumbling or sliding windows over event time, batch or stream.

    ``delay`` is how late rows may come in a stream; state older than that goes.
    """
    src = df.withWatermark(time, delay) if delay else df
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = src.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def session_windows(df: DataFrame, time: str, gap: str, keys, aggregates, delay: str | None = None) -> DataFrame:
    """Windows that a pause of ``gap`` ends, per key."""
    src = df.withWatermark(time, delay) if delay else df
    out = src.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])
