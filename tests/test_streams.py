"""Stream sessions: ends, errors, and incremental results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.sources.tables import Tables
from quern.streaming.session import Availability, StreamError, StreamSession, deal_by_hash, session_windows, windowed

SCHEMA = StructType([StructField("k", LongType()), StructField("v", StringType())])
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def session(spark, tmp_path):
    return StreamSession(spark, str(tmp_path))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_pushed_batches_come_out_once(spark, session):
    s = session.declare("a", SCHEMA)
    assert s.availability() is Availability.WAITING
    s.push(rows(spark, (1, "x"), (2, None)))
    assert s.availability() is Availability.HAS_DATA
    assert s.drain().count() == 2
    s.push(rows(spark, (3, "z")))
    assert sorted(r["k"] for r in s.drain(lambda df: df.where("k <> 2")).collect()) == [1, 2, 3]
    assert s.availability() is Availability.WAITING


def test_a_stream_ends_when_all_senders_have_closed(spark, session):
    s = session.declare("a", SCHEMA, ["p", "q"])
    s.push(rows(spark, (1, "x")), "p")
    s.close("p")
    s.close("p")
    with pytest.raises(ValueError):
        s.push(rows(spark, (2, "y")), "p")
    s.drain()
    assert s.availability() is Availability.WAITING and not session.drained()
    s.close("q")
    assert s.availability() is Availability.END_OF_STREAM and session.drained()


def test_data_comes_before_the_end(spark, session):
    s = session.declare("a", SCHEMA)
    s.push(rows(spark, (1, "x")))
    s.close()
    assert s.availability() is Availability.HAS_DATA
    s.drain()
    assert s.availability() is Availability.END_OF_STREAM


def test_the_first_failure_stays(spark, session):
    s = session.declare("a", SCHEMA)
    s.fail("first")
    s.fail("second")
    for action in (s.availability, s.drain, s.close, lambda: s.push(rows(spark, (1, "x")))):
        with pytest.raises(StreamError, match="first"):
            action()


def test_a_failing_query_fails_the_stream(spark, session):
    s = session.declare("a", SCHEMA)
    s.push(rows(spark, (1, "x")))
    with pytest.raises(StreamError):
        s.drain(lambda df: df.withColumn("v", F.raise_error(F.lit("no")).cast("string")))
    with pytest.raises(StreamError):
        s.availability()


def test_unknown_names_are_errors(spark, session):
    s = session.declare("a", SCHEMA)
    with pytest.raises(ValueError):
        session.declare("a", SCHEMA)
    with pytest.raises(KeyError):
        session.input("b")
    with pytest.raises(ValueError):
        s.close("nobody")


def test_dealing_by_hash_is_a_partition(spark):
    e = Tables(spark, FOLDER).events.select("event_id", "user_id")
    parts = deal_by_hash(e, 4, "user_id")
    assert sum(p.count() for p in parts) == e.count()
    users = [{r[0] for r in p.select("user_id").distinct().collect()} for p in parts]
    assert len(set.union(*users)) == sum(map(len, users))


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    e = Tables(spark, FOLDER).events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    aggregate = [F.count(F.lit(1)).alias("n")]
    stream = windowed(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "ts", "1 day", ["event_type"], aggregate, delay="365 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("windows").collect()}
    assert got == {tuple(r) for r in windowed(e, "ts", "1 day", ["event_type"], aggregate).collect()}


def test_session_windows(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:04:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:01:00")], "u int, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = session_windows(df, "t", "10 minutes", ["u"], [F.count(F.lit(1)).alias("n")]).orderBy("u", "session_start").collect()
    assert [(r["u"], r["n"]) for r in got] == [(1, 2), (1, 1), (2, 1)]
