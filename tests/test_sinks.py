"""Files, tables, batches and functions of one's own."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import user
from quern.sources import sinks
from quern.sources import tables as sources
from quern.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def test_files_are_cut_and_partitioned(spark, tmp_path):
    o = Tables(spark, FOLDER).orders
    sinks.write_parquet(o, str(tmp_path / "o"), ["o_orderstatus"], rows_per_file=100)
    back = sources.read_parquet(spark, str(tmp_path / "o"))
    assert back.count() == o.count()
    assert back.groupBy(F.col("_metadata.file_path")).count().where("count > 100").count() == 0
    with pytest.raises(Exception, match="already exists"):
        sinks.write_parquet(o, str(tmp_path / "o"))


def test_bucketed_tables_join_without_a_shuffle(spark):
    t = Tables(spark, FOLDER)
    a = sinks.save_bucketed(t.orders, "bucketed_orders", ["o_orderkey"], 4, "overwrite")
    b = sinks.save_bucketed(t.lineitem, "bucketed_lineitem", ["l_orderkey"], 4, "overwrite")
    joined = a.hint("merge").join(b, F.col("o_orderkey") == F.col("l_orderkey"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).count()
    sinks.append(spark, t.orders.limit(3), "bucketed_orders")
    assert spark.table("bucketed_orders").count() == t.orders.count() + 3


def test_batches_hold_all_rows(spark):
    df = spark.range(25).withColumn("s", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")))
    batches = list(sinks.arrow_batches(df, 10))
    assert [b.num_rows for b in batches] == [10, 10, 5]
    assert pa.Table.from_batches(batches).column("s").null_count == 12
    assert list(sinks.arrow_batches(df.limit(0))) == []


def test_user_aggregate(spark):
    user.register_aggregate(spark, "quern_range", lambda v: float(v.max() - v.min()), "double")
    Tables(spark, FOLDER).events.createOrReplaceTempView("e")
    got = {r[0]: r[1] for r in spark.sql("SELECT event_type, quern_range(value) FROM e GROUP BY event_type").collect()}
    want = spark.sql("SELECT event_type, max(value) - min(value) FROM e GROUP BY event_type").collect()
    assert got == pytest.approx({r[0]: r[1] for r in want})
