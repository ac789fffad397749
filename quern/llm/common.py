"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space, as a Java pattern; words are what lies between.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: A side of at most this many rows is broadcast after it has been counted.
BROADCAST_ROWS = 20_000
#: And of at most as many bytes, written as JSON.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, one is set only if all runs on one machine,
    as in tests; on a cluster executors couldn't read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: The lists that take the folders made in this context (thread or task), if any.
_watching: ContextVar[tuple[list[str], ...]] = ContextVar("watching", default=())


def new_folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    for made in _watching.get():
        made.append(path)
    return path


@contextmanager
def watch_folders(made: list[str]):
    """Append to ``made`` each folder that is made inside, by this thread."""
    token = _watching.set((*_watching.get(), made))
    try:
        yield made
    finally:
        _watching.reset(token)


def delete_folders(spark: SparkSession, paths) -> None:
    """Delete folders of the shared folder; missing ones are fine."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in tables:
        delete_folders(df.sparkSession, [df._quern_folder])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: what is read later survives the loss of executors, and
    its size is known to the planner, so adaptive execution can split skewed
    partitions on either side of a join over it.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_folder = path
    return out


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for at most ``max_rows`` rows and ``max_bytes`` bytes, both counted.

    ``df`` should be materialized. A larger side is left to a shuffled join.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns])))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def quoted(name: str) -> str:
    """A column name that may hold dots or blanks, for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct: keeps their names apart from an operator's own."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def one_per_label(rows: DataFrame, label: str) -> DataFrame:
    """One row (label, id, hash, rid) for each label: by smallest id (nulls last), then hash, then rid.

    An aggregation, so rows of one label are combined before the shuffle.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "rid")
    return rows.groupBy(label).agg(F.min(order).alias("least")).select(label, "least.id", "least.hash", "least.rid")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body`` of it.

    A lambda that refers to an outer expression would evaluate it again for
    each element; a one-element array binds it to a variable first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files that nothing refers to any more.

    They go when the driver's garbage is collected, which between large steps
    may be long after their last use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
