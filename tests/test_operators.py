"""Operators where SQL can't be the oracle, errors, and plans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import decimals, predicates, scalar
from quern.operators import aggregates, joins, sorting, vector
from quern.plans import registry
from quern.plans.fixtures import fixture
from quern.sources import tables as sources
from quern.sources.tables import Tables

FOLDER = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = Tables(spark, FOLDER).lineitem.where("l_quantity > 49").select("l_orderkey")
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_null_safe_join_is_one_hash_join(spark):
    df = joins.join(fixture(spark, "mnl"), fixture(spark, "mnr"), [("a", "ra"), ("b", "rb")], null_safe=["b"])
    assert "NestedLoop" not in plan_of(df)


def test_asof_join_compares_no_pairs(spark):
    df = joins.asof_join(fixture(spark, "trades"), fixture(spark, "quotes"), ("t_time", "q_time"), [("t_key", "q_key")], ["q_price"])
    assert "Join" not in plan_of(df)


def test_hive_partitions_are_pruned(spark, tmp_path):
    Tables(spark, FOLDER).nation.write.partitionBy("n_regionkey").parquet(str(tmp_path / "n"))
    df = sources.read_parquet(spark, str(tmp_path / "n")).where("n_regionkey = 2")
    assert "PartitionFilters: [isnotnull(n_regionkey" in plan_of(df)
    assert df.count() == 5


def test_join_names_are_checked(spark):
    with pytest.raises(ValueError):
        joins.join(fixture(spark, "l"), fixture(spark, "r"), [("k", "rk")], "sideways")


def test_scalar_subquery_with_two_rows_fails(spark):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY"):
        spark.sql("SELECT (SELECT * FROM VALUES (1), (2))").collect()


def test_sum_overflow_is_an_error(spark):
    df = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "x long")
    with pytest.raises(ArithmeticException):
        df.agg(F.sum("x")).collect()


def test_decimals_round_half_away_and_fail_beyond_38_digits(spark):
    df = spark.sql("SELECT CAST(1 AS DECIMAL(10,2)) a, CAST(8 AS DECIMAL(10,2)) b, CAST(0 AS DECIMAL(10,2)) z, CAST(-7 AS DECIMAL(10,2)) m")
    got = df.select(decimals.divide(F.col("a"), F.col("b"), 10, 2), decimals.divide(-F.col("a"), F.col("b"), 10, 2), decimals.divide(F.col("a"), F.col("z")), decimals.integer_divide(F.col("m"), F.lit(2)), decimals.modulo(F.col("m"), F.col("z"))).first()
    assert [None if x is None else float(x) for x in got] == [0.13, -0.13, None, -3.0, None]
    with pytest.raises(ValueError):
        decimals.add(F.lit(1), F.lit(2), 39, 0)


def test_regexp_first_takes_replacement_literally(spark):
    df = spark.createDataFrame([("a.b\nab",)], "s string")
    assert df.select(scalar.regexp_replace_first(F.col("s"), "b", "$1\\")).first()[0] == "a.$1\\\nab"


def test_in_list_of_nulls(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert [r[0] for r in df.select(predicates.in_list(F.col("x"), [None])).collect()] == [None, None]
    assert [r[0] for r in df.select(predicates.in_list(F.col("x"), [])).collect()] == [False, None]


def test_mark_in_over_empty_side_is_false(spark):
    left, right = fixture(spark, "l"), fixture(spark, "r").limit(0)
    assert {r["mark"] for r in joins.mark_in(left, right, "k", "rk").collect()} == {False}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_shuffled_and_matches_the_plain_one(spark, how):
    left = spark.range(900).select("id", F.when(F.col("id") % 9 > 0, F.when(F.col("id") < 700, 1).otherwise(F.col("id"))).alias("k"))
    right = spark.range(0, 1000, 3).union(spark.range(2)).select(F.col("id").alias("rk"))
    got = joins.salted_join(left, right, [("k", "rk")], 4, how)
    assert "BroadcastHashJoin" not in plan_of(got) and "SortMergeJoin" in plan_of(got)
    want = left.join(right, F.col("k") == F.col("rk"), how)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "BroadcastHashJoin" not in str(got._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["join_salted", "join_salted_whole"])
def test_salted_queries_hold_no_repeated_table_in_each_task(spark, name):
    assert "BroadcastExchange" not in plan_of(registry.QUERIES[name](spark, FOLDER))


def test_salted_query_is_not_turned_into_a_broadcast_as_it_runs(spark):
    df = registry.QUERIES["join_salted_whole"](spark, FOLDER)
    assert len(df.collect()) == Tables(spark, FOLDER).lineitem.count()
    plan = plan_of(df)
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_numbering_is_dense_over_partitions(spark):
    df = spark.range(1000).repartition(7)
    got = joins.numbered(df, ["id"], "p").where("id <> p").count()
    assert got == 0


def test_dense_count_matches_the_join(spark):
    c, o = fixture(spark, "cust"), fixture(spark, "ord")
    want = c.join(o, F.col("c_id") == F.col("o_cust"), "left").groupBy("c_id").agg(F.count("o_val").alias("n"))
    assert sorted(map(tuple, want.collect()), key=repr) == sorted(map(tuple, aggregates.dense_count(c, o, "c_id", "o_cust", "o_val").collect()), key=repr)


def test_sketches_are_kept_per_group_not_per_pair(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 > 0, F.col("id") % 700).alias("v"))
    out = aggregates.distinct_and_approx(df, ["g"], "v", 0.01)
    want = df.groupBy("g").agg(F.countDistinct("v").alias("n"), F.approx_count_distinct("v", 0.01).alias("approx"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    # Sketches are merged per pair where distinct and other aggregates share an aggregation.
    assert "merge_approx_count_distinct" in plan_of(want)
    assert "merge_approx_count_distinct" not in plan_of(registry.QUERIES["agg_approx_distinct"](spark, FOLDER))


def test_approximate_count_of_a_group_of_nulls_is_near(spark, tmp_path):
    rows = [("A", k) for k in range(50)] + [("N", None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["agg_approx_distinct"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("A", 50, True), ("N", 0, True)]


def test_limit_percent_bounds(spark):
    with pytest.raises(ValueError):
        sorting.limit_percent(spark.range(3), ["id"], 101)
    assert sorting.limit_percent(spark.range(3), ["id"], 0).count() == 0


def test_knn_rejects_bad_arguments_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [1.0])], "id long, v array<double>")
    got = vector.knn_search(df, "v", [0.0, 0.0], 10, tie="id").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(1, 0.0), (2, 5.0)]
    assert [r["id"] for r in vector.knn_search(df, "v", [1.0, 1.0], 10, "cosine").collect()] == [2]
    with pytest.raises(ValueError):
        vector.knn_search(df, "v", [0.0, 0.0], 0)
    with pytest.raises(ValueError):
        vector.knn_search(df, "v", [0.0, 0.0], 1, "manhattan")


@pytest.mark.parametrize("n_lists", [None, 16, 256])
def test_ivf_recall_with_the_measured_probes(spark, n_lists):
    e = Tables(spark, FOLDER).embeddings
    indexes = vector.VectorIndexes(spark)
    indexes.create("e", e, "embedding", n_lists=n_lists)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    exact = {tuple(r) for r in vector.knn_join(q, e, "q_id", "q", "vec_id", "embedding", 10).select("q_id", "vec_id").collect()}
    found = {tuple(r) for r in indexes.search_all("e", q, "q_id", "q", "vec_id").select("q_id", "vec_id").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    first = q.first()
    alone = {r["vec_id"] for r in indexes.search("e", first["q"], 10, tie="vec_id").collect()}
    assert alone == {r for k, r in found if k == first["q_id"]}
    indexes.drop("e")
    with pytest.raises(KeyError):
        indexes.search("e", first["q"])


@pytest.mark.parametrize("metric", vector.METRICS)
def test_ivf_batch_answers_as_single_searches(spark, monkeypatch, metric):
    # Small bounds: large cells are dealt to several shards, queries to several blocks, distances to several rounds.
    monkeypatch.setattr(vector, "SHARDS", 400)
    monkeypatch.setattr(vector, "SHARD_ROWS", (8, 32))
    monkeypatch.setattr(vector, "ASKED_ROWS", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 6)).round(1).tolist() + [[0.5] * 6] * 200 + [[0.0] * 6] * 3 + [[1e-120] * 6, [1e-121] * 6, [1e120] * 6]
    rows = [(k, v) for k, v in zip(rng.permutation(len(vectors)).tolist(), vectors)] + [(9000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    indexes = vector.VectorIndexes(spark)
    indexes.create("e", df, "v", metric, n_lists=9)
    asked = [r for r in rows if r[1] is not None][::60] + [(9001, [0.5] * 6), (9002, [0.0] * 6), (9003, [1e-121] * 6)]
    found = {}
    for r in indexes.search_all("e", spark.createDataFrame([*asked, (9004, None)], "q_id long, q array<double>"), "q_id", "q", "id", 15).collect():
        found.setdefault(r["q_id"], []).append((r["distance"], r["id"]))
    for q_id, q in asked:
        alone = indexes.search("e", q, 15, tie="id").collect()
        assert [(np.float32(d), k) for d, k in sorted(found.get(q_id, []))] == [(np.float32(r["distance"]), r["id"]) for r in alone]
    indexes.drop("e")


def test_fitted_vectors_are_those_of_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(vector, "FIT_ROWS", 100)
    df = spark.range(3000).select(F.array(F.col("id").cast("double")).alias("v"))
    copies = df.limit(20).union(spark.range(2000).select(F.array(F.lit(-1.0)).alias("v")))
    for rows in (df, copies):
        want = [r["v"] for r in rows.orderBy(F.xxhash64("v", F.lit(42))).limit(100).collect()]
        assert [r["v"] for r in vector._fit_rows(rows, "v", rows.count(), 42)] == want


def test_ivf_batch_makes_no_row_per_pair(spark):
    e = Tables(spark, FOLDER).embeddings
    indexes = vector.VectorIndexes(spark)
    indexes.create("e", e, "embedding")
    plan = plan_of(indexes.search_all("e", e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), "q_id", "q", "vec_id"))
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    indexes.drop("e")


def test_error_is_raised_where_a_row_takes_the_branch(spark):
    df = spark.range(3).select(F.when(F.col("id") > 1, F.raise_error(F.lit("no")).cast("string")).otherwise("fine").alias("e"))
    with pytest.raises(Exception, match="no"):
        df.collect()


def test_knn_join_cosine_matches_numpy(spark):
    e = Tables(spark, FOLDER).embeddings
    q = e.where("vec_id % 250 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    got = vector.knn_join(q, e, "q_id", "q", "vec_id", "embedding", 3, "cosine").collect()
    rows = e.collect()
    x = np.array([r["embedding"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r["vec_id"] for r in rows]
    for r in got:
        order = np.argsort(-(x @ x[ids.index(r["q_id"])]))[:3]
        assert r["vec_id"] in {ids[k] for k in order}


def test_pins_answer_from_memory_and_are_dropped(spark):
    engine = Engine(spark)
    engine.register(FOLDER, ["nation"])
    engine.pins.pin("pinned_nation", Tables(spark, FOLDER).nation, ["n_name", "n_regionkey"], "memory")
    df = engine.sql("SELECT count(*) AS n FROM pinned_nation WHERE n_regionkey = :r", label="count", r=1)
    assert "InMemoryTableScan" in plan_of(df) and df.first()["n"] == 5
    with pytest.raises(ValueError):
        engine.pins.pin("pinned_nation", Tables(spark, FOLDER).nation)
    engine.pins.unpin("pinned_nation")
    with pytest.raises(KeyError):
        engine.pins.unpin("pinned_nation")
    engine.reset()
    assert engine.pins.names() == []


def test_small_sides_only_are_hinted(spark):
    assert "ResolvedHint" in joins.broadcast_checked(spark.range(5), 5)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in joins.broadcast_checked(spark.range(6), 5)._jdf.queryExecution().analyzed().toString()
