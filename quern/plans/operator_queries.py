"""One query per operator or function, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import decimals, predicates, scalar, user
from quern.operators import aggregates, joins, reshape, setops, sorting, vector, windows
from quern.plans.fixtures import fixture, with_fixtures
from quern.sources import sinks
from quern.sources import tables as sources
from quern.sources.tables import Tables
from quern.streaming import session as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, fixtures=()):
    """Register a function under its name, with its SQL over tables or literal fixtures."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (with_fixtures(*fixtures) if fixtures else "") + sql
        return f

    return add


# Scans


@query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_parquet(spark, f"{d}/region.parquet")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49 AND l_shipdate >= TIMESTAMP '2001-01-01'")
def scan_filter_pushdown(spark, d):
    return Tables(spark, d).lineitem.where("l_quantity > 49 AND l_shipdate >= timestamp_ntz '2001-01-01'").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def scan_projection(spark, d):
    return Tables(spark, d).customer.select("c_custkey", "c_mktsegment")


@query("SELECT 'nation.parquet' AS file, CAST(0 AS BIGINT) AS file_index, CAST(n_nationkey AS BIGINT) AS file_row_number, n_name FROM nation")
def scan_file_columns(spark, d):
    df = sources.with_file_columns(Tables(spark, d).nation)
    return df.select(F.regexp_extract("filename", r"([^/]+\.parquet)", 1).alias("file"), "file_index", "file_row_number", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 3, 24)")
def scan_positional_deletes(spark, d):
    df = sources.with_file_columns(Tables(spark, d).nation)
    deletes = df.where("n_nationkey IN (1, 3, 24)").select(F.col("filename").alias("file_path"), F.col("file_row_number").alias("pos"))
    return sources.without_deleted(df, deletes).select("n_nationkey", "n_name")


@query("SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'a'), (2, NULL), (NULL, 'c')) v(x, y)")
def scan_values(spark, d):
    return sources.values(spark, [(1, "a"), (2, None), (None, "c")], "x int, y string")


@query("SELECT CAST(1 + 2 AS INTEGER) AS three, 'x' AS s")
def scan_one_row(spark, d):
    return sources.one_row(spark).select((F.lit(1) + 2).alias("three"), F.lit("x").alias("s"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 5 AND n_nationkey < 5")
def scan_empty(spark, d):
    return Tables(spark, d).nation.where("n_nationkey > 5 AND n_nationkey < 5").select("n_nationkey", "n_name")


# Predicates


@query("SELECT id, i < 15 AS lt, i <= 10 AS le, i > 10 AS gt, i >= 20 AS ge, i = 10 AS eq, i <> 10 AS ne FROM nt", ["nt"])
def pred_compare(spark, d):
    i = F.col("i")
    return fixture(spark, "nt").select("id", (i < 15).alias("lt"), (i <= 10).alias("le"), (i > 10).alias("gt"), (i >= 20).alias("ge"), (i == 10).alias("eq"), (i != 10).alias("ne"))


@query("SELECT id, i IS DISTINCT FROM CAST(b / 10 AS INTEGER) AS d, i IS NOT DISTINCT FROM CAST(b / 10 AS INTEGER) AS s FROM nt", ["nt"])
def pred_distinct_from(spark, d):
    b = F.round(F.col("b") / 10).cast("int")
    return fixture(spark, "nt").select("id", predicates.distinct_from(F.col("i"), b).alias("d"), F.col("i").eqNullSafe(b).alias("s"))


@query("SELECT id, (i > 5 AND b > 50) AS a, (i > 5 OR b > 50) AS o, NOT (i > 5) AS n FROM nt", ["nt"])
def pred_kleene(spark, d):
    p, q = F.col("i") > 5, F.col("b") > 50
    return fixture(spark, "nt").select("id", predicates.every(p, q).alias("a"), predicates.some(p, q).alias("o"), (~p).alias("n"))


@query("SELECT id FROM nt WHERE i IS NULL AND s IS NOT NULL", ["nt"])
def pred_is_null(spark, d):
    return fixture(spark, "nt").where("i IS NULL AND s IS NOT NULL").select("id")


@query("SELECT id, i BETWEEN 0 AND 10 AS cc, i > 0 AND i < 10 AS oo, i > 0 AND i <= 10 AS oc FROM nt", ["nt"])
def pred_between(spark, d):
    i = F.col("i")
    return fixture(spark, "nt").select("id", predicates.between(i, 0, 10).alias("cc"), predicates.between(i, 0, 10, True, True).alias("oo"), predicates.between(i, 0, 10, True).alias("oc"))


@query("SELECT id, i IN (10, 20) AS a, i IN (10, NULL) AS b, i NOT IN (10, NULL) AS c, s IN ('fig', '') AS d FROM nt", ["nt"])
def pred_in_list(spark, d):
    i = F.col("i")
    return fixture(spark, "nt").select("id", predicates.in_list(i, [10, 20]).alias("a"), predicates.in_list(i, [10, None]).alias("b"), (~predicates.in_list(i, [10, None])).alias("c"), predicates.in_list(F.col("s"), ["fig", ""]).alias("d"))


@query("SELECT id, CASE WHEN i > 15 THEN 'big' WHEN i > 5 THEN 'mid' ELSE 'other' END AS c, coalesce(i, b, -1) AS k, nullif(i, 10) AS z FROM nt", ["nt"])
def pred_case_coalesce(spark, d):
    i = F.col("i")
    return fixture(spark, "nt").select("id", F.when(i > 15, "big").when(i > 5, "mid").otherwise("other").alias("c"), F.coalesce(i.cast("long"), F.col("b"), F.lit(-1).cast("long")).alias("k"), F.nullif(i, F.lit(10)).alias("z"))


@query("SELECT id, CAST(dbl AS INTEGER) AS i, CAST(b AS DOUBLE) AS f, CAST(i AS VARCHAR) AS s, TRY_CAST(s AS INTEGER) AS t, CAST(b AS DECIMAL(10,2)) AS m FROM nt WHERE dbl IS NULL OR dbl <> 2.5 AND dbl <> 4.5", ["nt"])
def pred_cast(spark, d):
    df = fixture(spark, "nt").where("dbl IS NULL OR dbl <> 2.5 AND dbl <> 4.5")
    return df.select("id", scalar.cast_rounded(F.col("dbl"), "int").alias("i"), F.col("b").cast("double").alias("f"), F.col("i").cast("string").alias("s"), F.expr("try_cast(s AS int)").alias("t"), F.col("b").cast("decimal(10,2)").alias("m"))


# Functions


@query("SELECT id, a + b AS p, a - b AS m, a * b AS t, a / b AS q, CAST(a // b AS BIGINT) AS i, a % b AS r FROM nums", ["nums"])
def fn_arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    return fixture(spark, "nums").select("id", (a + b).alias("p"), (a - b).alias("m"), (a * b).alias("t"), (a / b).alias("q"), scalar.int_divide(a, b).alias("i"), (a % b).alias("r"))


@query("SELECT id, substring(s, 2, 3) AS a, substring(s, 0, 2) AS b, substring(s, 4) AS c FROM texts", ["texts"])
def fn_substring(spark, d):
    s = F.col("s")
    return fixture(spark, "texts").select("id", scalar.substring(s, 2, 3).alias("a"), scalar.substring(s, 0, 2).alias("b"), scalar.substring(s, 4, 1 << 30).alias("c"))


@query(r"SELECT id, s LIKE '%l%w%' AS a, s NOT LIKE 'a%' AS b, s LIKE 'a\b' AS c, s LIKE '_Xb%' AS e, contains(s, 'X') AS f, prefix(s, 'a') AS g, suffix(s, 'c') AS h FROM texts", ["texts"])
def fn_like(spark, d):
    s = F.col("s")
    return fixture(spark, "texts").select("id", scalar.like(s, "%l%w%").alias("a"), (~scalar.like(s, "a%")).alias("b"), scalar.like(s, "a\\b").alias("c"), scalar.like(s, "_Xb%").alias("e"), s.contains("X").alias("f"), s.startswith("a").alias("g"), s.endswith("c").alias("h"))


@query("SELECT id, CAST(strlen(s) AS BIGINT) AS bytes, CAST(length(s) AS BIGINT) AS chars, concat(s, NULL, '!') AS c, s || '!' AS o FROM texts", ["texts"])
def fn_length_concat(spark, d):
    s = F.col("s")
    return fixture(spark, "texts").select("id", scalar.byte_length(s).alias("bytes"), scalar.char_length(s).alias("chars"), scalar.concat_skip(s, F.lit(None).cast("string"), F.lit("!")).alias("c"), scalar.concat_strict(s, F.lit("!")).alias("o"))


@query(r"SELECT id, regexp_replace(s, '([a-c])X', '<\1>', 'g') AS a, regexp_replace(s, 'a', '$') AS f FROM texts", ["texts"])
def fn_regexp_replace(spark, d):
    s = F.col("s")
    return fixture(spark, "texts").select("id", scalar.regexp_replace_all(s, "([a-c])X", r"<\1>").alias("a"), scalar.regexp_replace_first(s, "a", "$").alias("f"))


@query("""SELECT id, year(t) AS y, month(t) AS m, day(t) AS dd, hour(t) AS h, minute(t) AS mi, second(t) AS s,
  CAST(millisecond(t) AS BIGINT) AS ms, CAST(microsecond(t) AS BIGINT) AS us FROM ts""", ["ts"])
def fn_date_parts(spark, d):
    t = F.col("t")
    parts = [f(t).cast("long").alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.day, "dd"), (F.hour, "h"), (F.minute, "mi"), (F.second, "s"))]
    return fixture(spark, "ts").select("id", *parts, scalar.subsecond(t, 1000).alias("ms"), scalar.subsecond(t, 1_000_000).alias("us"))


@query("""SELECT id, CAST(date_trunc('day', t) AS TIMESTAMP) AS d, date_trunc('hour', t) AS h, date_trunc('minute', t) AS m,
  date_trunc('second', t) AS s, date_trunc('millisecond', t) AS ms, CAST(date_trunc('month', t) AS TIMESTAMP) AS mo FROM ts""", ["ts"])
def fn_date_trunc(spark, d):
    t = F.col("t")
    return fixture(spark, "ts").select("id", *[scalar.date_trunc(u, t).alias(n) for u, n in (("day", "d"), ("hour", "h"), ("minute", "m"), ("second", "s"), ("millisecond", "ms"), ("month", "mo"))])


@query("SELECT upper(n_name) AS u, lower(n_name) AS l, trim('  ' || n_name || ' ') AS t, replace(n_name, 'N', 'M') AS r, split_part(n_name, '_', 2) AS p, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS k, reverse(n_name) AS v FROM nation")
def fn_text(spark, d):
    n = F.col("n_name")
    return Tables(spark, d).nation.select(F.upper(n).alias("u"), F.lower(n).alias("l"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.replace(n, F.lit("N"), F.lit("M")).alias("r"), F.split_part(n, F.lit("_"), F.lit(2)).alias("p"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("k"), F.reverse(n).alias("v"))


@query("SELECT s_suppkey, abs(s_acctbal - 5000) AS a, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, round(sqrt(abs(s_acctbal)), 6) AS q, greatest(s_acctbal, 100.0) AS g, least(s_acctbal, 100.0) AS l, sign(s_acctbal - 5000) AS s FROM supplier")
def fn_math(spark, d):
    x = F.col("s_acctbal")
    return Tables(spark, d).supplier.select("s_suppkey", F.abs(x - 5000).alias("a"), F.floor(x).cast("double").alias("f"), F.ceil(x).cast("double").alias("c"), F.round(F.sqrt(F.abs(x)), 6).alias("q"), F.greatest(x, F.lit(100.0)).alias("g"), F.least(x, F.lit(100.0)).alias("l"), F.sign(x - 5000).cast("int").alias("s"))


@query("""SELECT id, CAST(CAST(a AS DECIMAL(12,2)) * CAST(b AS DECIMAL(12,2)) AS DECIMAL(38,6)) AS t, CAST(a AS DECIMAL(38,6)) + b AS p,
  CASE WHEN a IS NULL OR b = 0 THEN NULL ELSE CAST(round(a / b, 6) AS DECIMAL(38,6)) END AS q FROM nums""", ["nums"])
def fn_exact_decimals(spark, d):
    a, b = (F.col(c).cast("decimal(12,2)") for c in "ab")
    return fixture(spark, "nums").select("id", decimals.multiply(a, b).alias("t"), decimals.add(a, b).alias("p"), decimals.divide(a, b).alias("q"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(spark, d):
    return Tables(spark, d).events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first, round(list_max(embedding), 5) AS top, len(list_filter(embedding, lambda x: x > 0)) AS pos FROM embeddings")
def fn_arrays(spark, d):
    e = F.col("embedding")
    return Tables(spark, d).embeddings.select("vec_id", F.size(e).cast("long").alias("n"), F.get(e, F.lit(0)).alias("first"), F.round(F.array_max(e), 5).alias("top"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("pos"))


# Joins


def _lr(spark):
    return fixture(spark, "l"), fixture(spark, "r")


def _keyed_join(how: str, sql_how: str, columns="*"):
    @query(f"SELECT {columns} FROM l {sql_how} r ON k = rk", ["l", "r"])
    def run(spark, d):
        left, right = _lr(spark)
        return joins.join(left, right, [("k", "rk")], how)

    return run


for _how, _sql, _columns in (("inner", "JOIN", "*"), ("left", "LEFT JOIN", "*"), ("right", "RIGHT JOIN", "*"), ("full", "FULL JOIN", "*"), ("left_semi", "SEMI JOIN", "l.*"), ("left_anti", "ANTI JOIN", "l.*")):
    _run = _keyed_join(_how, _sql, _columns)
    QUERIES[f"join_{_how}"], SQL[f"join_{_how}"] = QUERIES.pop("run"), SQL.pop("run")


@query("SELECT r.* FROM r SEMI JOIN l ON k = rk", ["l", "r"])
def join_right_semi(spark, d):
    return joins.join(*_lr(spark), [("k", "rk")], "right_semi")


@query("SELECT r.* FROM r ANTI JOIN l ON k = rk", ["l", "r"])
def join_right_anti(spark, d):
    return joins.join(*_lr(spark), [("k", "rk")], "right_anti")


@query("SELECT * FROM l FULL JOIN r ON k IS NOT DISTINCT FROM rk", ["l", "r"])
def join_null_safe(spark, d):
    return joins.join(*_lr(spark), [("k", "rk")], "full", null_safe=["k"])


@query("SELECT * FROM mnl LEFT JOIN mnr ON a = ra AND b IS NOT DISTINCT FROM rb", ["mnl", "mnr"])
def join_mixed_null_safe(spark, d):
    return joins.join(fixture(spark, "mnl"), fixture(spark, "mnr"), [("a", "ra"), ("b", "rb")], "left", null_safe=["b"])


@query("SELECT * FROM l LEFT JOIN r ON k = rk AND id < rid", ["l", "r"])
def join_residual(spark, d):
    left, right = _lr(spark)
    return joins.join(left, right, [("k", "rk")], "left", residual=left["id"] < right["rid"])


for _how, _sql, _columns in (("inner", "JOIN", "*"), ("left", "LEFT JOIN", "*"), ("right", "RIGHT JOIN", "*"), ("full", "FULL JOIN", "*"), ("left_semi", "SEMI JOIN", "l.*"), ("left_anti", "ANTI JOIN", "l.*")):

    def _theta(spark, d, how=_how):
        left, right = _lr(spark)
        return joins.theta_join(left, right, left["k"] < right["rk"], how)

    QUERIES[f"join_theta_{_how}"] = _theta
    SQL[f"join_theta_{_how}"] = with_fixtures("l", "r") + (f"SELECT {_columns} FROM l {_sql} r ON k < rk" if _how[:5] != "left_" else f"SELECT * FROM l WHERE {'NOT ' * (_how == 'left_anti')}EXISTS (SELECT * FROM r WHERE k < rk)")


@query("SELECT id, k, k IN (SELECT rk FROM r) AS mark FROM l", ["l", "r"])
def join_mark_in(spark, d):
    return joins.mark_in(*_lr(spark), "k", "rk")


@query("SELECT id, k, k IN (SELECT rk FROM r WHERE rid > 100) AS mark FROM l", ["l", "r"])
def join_mark_in_empty(spark, d):
    left, right = _lr(spark)
    return joins.mark_in(left, right.where("rid > 100"), "k", "rk")


@query("SELECT id, k, EXISTS (SELECT * FROM r WHERE rk = k) AS mark FROM l", ["l", "r"])
def join_mark_exists(spark, d):
    return joins.mark_exists(*_lr(spark), [("k", "rk")])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey % 100 = c_custkey")
def join_expression_key(spark, d):
    t = Tables(spark, d)
    return t.orders.join(joins.broadcast_checked(t.customer), F.col("o_custkey") % 100 == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    t = Tables(spark, d)
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT t_id, t_key, t_time, q_time, q_price FROM trades ASOF JOIN quotes ON t_key = q_key AND t_time >= q_time", ["trades", "quotes"])
def join_asof(spark, d):
    return joins.asof_join(fixture(spark, "trades"), fixture(spark, "quotes"), ("t_time", "q_time"), [("t_key", "q_key")], ["q_price"])


@query("""SELECT e.event_id, p.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof_events(spark, d):
    e = Tables(spark, d).events
    views = e.where("event_type = 'view'").select(F.col("user_id").alias("u"), F.col("ts").alias("vts"), F.col("event_id").alias("last_view"))
    return joins.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ("ts", "vts"), [("user_id", "u")], ["last_view"], "left").select("event_id", "last_view")


@query("SELECT n_name, s_name FROM (SELECT *, row_number() OVER (ORDER BY n_name) p FROM nation) FULL JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey DESC) q FROM supplier) ON p = q")
def join_positional(spark, d):
    t = Tables(spark, d)
    return joins.positional_join(t.nation.select("n_name"), t.supplier.select("s_suppkey", "s_name"), ["n_name"], [F.desc("s_suppkey")]).select("n_name", "s_name")


@query("""SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN events b ON a.user_id = b.user_id
  AND abs(a.value - b.value) <= 0.5 WHERE a.event_type = 'error' AND b.event_type = 'purchase'""")
def join_band(spark, d):
    e = Tables(spark, d).events
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("x"), F.col("user_id").alias("u"), F.col("value").alias("v"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("y"), F.col("user_id").alias("u2"), F.col("value").alias("v2"))
    return joins.band_join(a, b, "v", "v2", 0.5, [("u", "u2")]).select("x", "y")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def join_salted(spark, d):
    t = Tables(spark, d)
    return joins.salted_join(t.lineitem, t.part, [("l_partkey", "p_partkey")], 4, "left").select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def join_salted_whole(spark, d):
    t = Tables(spark, d)
    return joins.salted_join(t.lineitem, t.part, [("l_partkey", "p_partkey")], 4, "left").select("l_orderkey", "l_linenumber", "p_brand")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey < 0) ON c_custkey = o_custkey GROUP BY c_custkey")
def join_empty_side(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.where("o_orderkey < 0"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


# Aggregates


@query("SELECT count(*) AS n, count(v) AS nv, CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi, avg(v) AS m, avg(f) AS mf FROM agg_n", ["agg_n"])
def agg_ungrouped(spark, d):
    return fixture(spark, "agg_n").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.avg("f").alias("mf"))


@query("SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS s, max(v) AS hi FROM agg_n WHERE v > 1000", ["agg_n"])
def agg_ungrouped_empty(spark, d):
    return fixture(spark, "agg_n").where("v > 1000").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.max("v").alias("hi"))


@query("SELECT g, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(d) AS DECIMAL(20,2)) AS sd, avg(f) AS m FROM agg_n GROUP BY g", ["agg_n"])
def agg_group_null_key(spark, d):
    return fixture(spark, "agg_n").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum("d").cast("decimal(20,2)").alias("sd"), F.avg("f").alias("m"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment")
def agg_group(spark, d):
    return Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("s"), F.min("c_name").alias("lo"), F.max("c_name").alias("hi"))


@query("SELECT g, arg_min(v, coalesce(v, 0)) AS x FROM agg_n WHERE v IS NOT NULL GROUP BY g", ["agg_n"])
def agg_first(spark, d):
    return fixture(spark, "agg_n").where("v IS NOT NULL").groupBy("g").agg(aggregates.first_by("v", "v").alias("x"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n"), F.countDistinct("l_suppkey").alias("m"))


@query("SELECT count(DISTINCT (a, b)) AS n FROM pairs", ["pairs"])
def agg_count_distinct_tuple(spark, d):
    return fixture(spark, "pairs").agg(aggregates.count_distinct_tuple("a", "b").alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def agg_count_distinct_two_step(spark, d):
    return aggregates.two_step_count_distinct(Tables(spark, d).lineitem, ["l_suppkey"], "l_partkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_distinct_rows(spark, d):
    return Tables(spark, d).lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT c_id, count(o_val) AS n FROM cust LEFT JOIN ord ON c_id = o_cust GROUP BY c_id", ["cust", "ord"])
def agg_dense_count(spark, d):
    return aggregates.dense_count(fixture(spark, "cust"), fixture(spark, "ord"), "c_id", "o_cust", "o_val")


@query("SELECT c_id, count(*) AS n FROM cust LEFT JOIN ord ON c_id = o_cust GROUP BY c_id", ["cust", "ord"])
def agg_dense_count_rows(spark, d):
    return aggregates.dense_count(fixture(spark, "cust"), fixture(spark, "ord"), "c_id", "o_cust")


@query("SELECT g, count(v) FILTER (WHERE v > 10) AS n, CAST(sum(v) FILTER (WHERE v > 10) AS BIGINT) AS s FROM agg_n GROUP BY g", ["agg_n"])
def agg_filter(spark, d):
    v = F.col("v")
    return fixture(spark, "agg_n").groupBy("g").agg(aggregates.filtered(F.count, v, v > 10).alias("n"), aggregates.filtered(F.sum, v, v > 10).alias("s"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def agg_grouping_sets(spark, d):
    return aggregates.grouping_sets(Tables(spark, d).lineitem, [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], [F.count(F.lit(1)).alias("n")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return Tables(spark, d).lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("g"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return Tables(spark, d).lineitem.cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c,
  median(l_quantity) AS md, quantile_cont(l_quantity, 0.9) AS q9, bool_and(l_quantity > 0) AS al, bit_or(l_linenumber) AS bo FROM lineitem GROUP BY l_returnflag""")
def agg_statistics(spark, d):
    q = F.col("l_quantity")
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.var_pop(q), 6).alias("vp"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"), F.median(q).alias("md"), F.percentile(q, 0.9).alias("q9"), F.bool_and(q > 0).alias("al"), F.bit_or("l_linenumber").alias("bo"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list(n_nationkey ORDER BY n_nationkey) AS ids, arg_max(n_name, n_nationkey) AS last FROM nation GROUP BY n_regionkey")
def agg_lists(spark, d):
    return Tables(spark, d).nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.array_sort(F.collect_list("n_nationkey")).alias("ids"), F.max_by("n_name", "n_nationkey").alias("last"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n, TRUE AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(spark, d):
    # The exact number is held against SQL, the approximate one against the exact one.
    a = aggregates.distinct_and_approx(Tables(spark, d).lineitem, ["l_returnflag"], "l_partkey", 0.01, "n", "a")
    return a.select("l_returnflag", "n", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("near"))


@query("SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, avg(DISTINCT l_linenumber) AS m FROM lineitem GROUP BY l_returnflag")
def agg_sum_distinct(spark, d):
    n = "l_linenumber"
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.sum_distinct(n).alias("s"), F.expr(f"avg(DISTINCT {n})").alias("m"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    # One aggregation instead of a window: rows of a key are combined before the shuffle.
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return Tables(spark, d).orders.groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", "x.*")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS s, round(avg(value), 6) AS m FROM events GROUP BY event_type")
def agg_split_and_merge(spark, d):
    e = Tables(spark, d).events
    parts = streams.deal_by_hash(e, 3, "user_id")
    partial = setops.union_all(*[p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")) for p in parts])
    merged = aggregates.merge_partials(partial, ["event_type"], ["s"], ["n"], [("m", "s", "n")])
    return merged.select("event_type", "n", F.round("s", 2).alias("s"), F.round("m", 6).alias("m"))


# Order and limits


@query("SELECT id, k, row_number() OVER (ORDER BY k DESC NULLS LAST, id) AS p FROM l", ["l"])
def sort_nulls(spark, d):
    w = Window.orderBy(sorting.key("k", descending=True), sorting.key("id"))
    return fixture(spark, "l").select("id", "k", F.row_number().over(w).cast("long").alias("p"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_n(spark, d):
    return sorting.top_n(Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), [sorting.key("o_totalprice", True), sorting.key("o_orderkey")], 25)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 95")
def top_n_offset(spark, d):
    return sorting.top_n(Tables(spark, d).orders, [sorting.key("o_orderdate"), sorting.key("o_orderkey")], 10, 95).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 5")
def limit_offset(spark, d):
    return Tables(spark, d).orders.select("o_orderkey").orderBy("o_orderkey").offset(5).limit(100)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT (SELECT count(*) // 10 FROM customer)")
def limit_percent(spark, d):
    return sorting.limit_percent(Tables(spark, d).customer.select("c_custkey"), [sorting.key("c_custkey")], 10)


@query()
def sample_rows(spark, d):
    return sorting.sample_rows(Tables(spark, d).orders, 0.1, ["o_orderkey"]).select("o_orderkey")


# Set operations, CTEs, subqueries

_UNIONS = {
    "union_all": (setops.union_all, "SELECT * FROM ua UNION ALL SELECT * FROM ub"),
    "union_distinct": (setops.union_distinct, "SELECT * FROM ua UNION SELECT * FROM ub"),
    "except_distinct": (setops.except_distinct, "SELECT * FROM ub EXCEPT SELECT * FROM ua"),
    "except_all": (setops.except_all, "SELECT * FROM ub EXCEPT ALL SELECT * FROM ua"),
    "intersect_distinct": (setops.intersect_distinct, "SELECT * FROM ua INTERSECT SELECT * FROM ub"),
    "intersect_all": (setops.intersect_all, "SELECT * FROM ub INTERSECT ALL SELECT * FROM ua"),
}
for _name, (_f, _sql) in _UNIONS.items():

    def _setop(spark, d, f=_f, swap=_sql.startswith("SELECT * FROM ub")):
        a, b = fixture(spark, "ua"), fixture(spark, "ub")
        return f(b, a) if swap else f(a, b)

    QUERIES[f"set_{_name}"], SQL[f"set_{_name}"] = _setop, with_fixtures("ua", "ub") + _sql


def sql_query(name: str, spark_sql: str, oracle: str | None = None, views=("lineitem", "orders", "customer", "nation", "region")):
    """A query that is written in SQL for Spark too."""

    def run(spark, d):
        t = Tables(spark, d)
        for v in views:
            getattr(t, v).createOrReplaceTempView(v)
        return spark.sql(spark_sql)

    QUERIES[name], SQL[name] = run, oracle or spark_sql


sql_query("cte_reused", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM c a WHERE a.n > (SELECT avg(n) FROM c)")
sql_query("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
sql_query("sub_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql_query("sub_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql_query("sub_in", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
sql_query("sub_not_in", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
sql_query("sub_scalar_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("sub_scalar", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql_query("sub_lateral", "SELECT c_custkey, x.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) x")


# Windows


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS r, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt,
  round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def win_ranks(spark, d):
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return Tables(spark, d).orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("r"), F.dense_rank().over(v).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("nt"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"))


@query("""SELECT event_id, lag(value, 1) OVER w AS a, lead(value, 2, -1.0) OVER w AS b, first_value(value) OVER w AS f,
  nth_value(value, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_values(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return Tables(spark, d).events.select("event_id", F.lag("value", 1).over(w).alias("a"), F.lead("value", 2, -1.0).over(w).alias("b"), F.first("value").over(w).alias("f"), F.nth_value("value", 2).over(w).alias("n"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS run,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS m,
  count(*) OVER (PARTITION BY event_type) AS n FROM events""")
def win_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return Tables(spark, d).events.select("event_id", F.round(F.sum("value").over(w), 4).alias("run"), F.round(F.avg("value").over(w.rowsBetween(-2, 1)), 4).alias("m"), F.count(F.lit(1)).over(Window.partitionBy("event_type")).alias("n"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
def win_range(spark, d):
    return Tables(spark, d).part.select("p_partkey", F.count(F.lit(1)).over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)).alias("n"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def win_groups(spark, d):
    return windows.groups_frame(Tables(spark, d).part, ["p_brand"], "p_size", F.count(F.lit(1)), -1, 1, "n").select("p_partkey", "n")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def win_qualify(spark, d):
    return windows.top_per_group(Tables(spark, d).orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("""SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)""")
def win_sessions(spark, d):
    return windows.sessionize(Tables(spark, d).events, ["user_id"], "ts", 6 * 3600).select("event_id", "session")


# Shapes


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, embedding[i] AS x FROM embeddings, range(1, 65) r(i)")
def unnest(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    return reshape.unnest(e, "embedding", "x", "i").select("vec_id", F.col("i").cast("long").alias("i"), "x")


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, embedding[i] AS x FROM embeddings, range(1, 65) r(i)")
def unnest_whole(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "embedding")
    return reshape.unnest(e, "embedding", "x", "i").select("vec_id", F.col("i").cast("long").alias("i"), "x")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot(spark, d):
    return reshape.pivot(Tables(spark, d).events, ["user_id"], "event_type", ["click", "view"], F.count(F.lit(1)), 0)


@query("SELECT s_suppkey, 'bal' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nat', CAST(s_nationkey AS DOUBLE) FROM supplier")
def unpivot(spark, d):
    s = Tables(spark, d).supplier.select("s_suppkey", F.col("s_acctbal").alias("bal"), F.col("s_nationkey").cast("double").alias("nat"))
    return reshape.unpivot(s, ["s_suppkey"], ["bal", "nat"], "name", "value")


# Vectors and streams

_QUERY = [0.1 * ((7 * k) % 5 - 2) for k in range(64)]


@query(f"SELECT vec_id, CAST(round(array_distance(CAST(embedding AS DOUBLE[64]), CAST({_QUERY} AS DOUBLE[64])), 5) AS DOUBLE) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def knn_l2(spark, d):
    out = vector.knn_search(Tables(spark, d).embeddings, "embedding", _QUERY, 10, "l2", ["vec_id"], "vec_id")
    return out.select("vec_id", F.round(F.col("distance").cast("double"), 5).alias("distance"))


@query(f"SELECT vec_id, CAST(round(array_cosine_distance(CAST(embedding AS DOUBLE[64]), CAST({_QUERY} AS DOUBLE[64])), 5) AS DOUBLE) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def knn_cosine(spark, d):
    out = vector.knn_search(Tables(spark, d).embeddings, "embedding", _QUERY, 10, "cosine", ["vec_id"], "vec_id")
    return out.select("vec_id", F.round(F.col("distance").cast("double"), 5).alias("distance"))


@query("""SELECT q.vec_id AS q_id, e.vec_id AS n_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
  array_distance(CAST(q.embedding AS DOUBLE[64]), CAST(e.embedding AS DOUBLE[64])), e.vec_id) AS rank
FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5""")
def knn_join(spark, d):
    e = Tables(spark, d).embeddings
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    return vector.knn_join(q, e, "q_id", "q", "vec_id", "embedding", 5).select("q_id", F.col("vec_id").alias("n_id"), F.col("rank").cast("long").alias("rank"))


@query()
def knn_ivf(spark, d):
    indexes = vector.VectorIndexes(spark)
    e = Tables(spark, d).embeddings
    indexes.create("e", e, "embedding", "l2")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    return indexes.search_all("e", asked, "q_id", "q", "vec_id", 10)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type,
  count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY ALL""")
def stream_tumbling(spark, d):
    out = streams.windowed(Tables(spark, d).events, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("s")])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", "s")


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS window_start,
  time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS s
FROM events, range(2) r(k) GROUP BY ALL""")
def stream_sliding(spark, d):
    out = streams.windowed(Tables(spark, d).events, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("s")], "30 minutes")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", "s")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_sessions(spark, d):
    out = streams.session_windows(Tables(spark, d).events, "ts", "12 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


# More sources, sinks and expressions


@query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2) GROUP BY n_regionkey")
def sink_partitioned_files(spark, d):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/quern-nation-{uuid.uuid4().hex}"
    sinks.write_parquet(Tables(spark, d).nation, path, ["n_regionkey"])
    return sources.read_parquet(spark, path).where("n_regionkey IN (1, 2)").groupBy(F.col("n_regionkey").cast("int").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN b = 0 THEN NULL ELSE a / b END AS q, CASE WHEN b = 0 THEN NULL ELSE a % b END AS r, TRY_CAST('x' || id AS INTEGER) AS c FROM nums", ["nums"])
def pred_try(spark, d):
    a, b = F.col("a"), F.col("b")
    return fixture(spark, "nums").select("id", F.try_divide(a, b).alias("q"), F.try_mod(a, b).alias("r"), F.expr("try_cast(concat('x', id) AS int)").alias("c"))


@query("SELECT id, CASE WHEN i > 100 THEN error('no') ELSE 'fine' END AS e FROM nt", ["nt"])
def pred_case_error(spark, d):
    return fixture(spark, "nt").select("id", F.when(F.col("i") > 100, F.raise_error(F.lit("no")).cast("string")).otherwise("fine").alias("e"))


@query("SELECT g, count(DISTINCT p) AS n FROM (SELECT g, struct_pack(a := v, b := f) AS p FROM agg_n) GROUP BY g", ["agg_n"])
def fn_struct_pack(spark, d):
    packed = fixture(spark, "agg_n").select("g", F.struct(F.col("v").alias("a"), F.col("f").alias("b")).alias("p"))
    return packed.groupBy("g").agg(F.countDistinct("p").alias("n"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS m, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS n, strftime(o_orderdate, '%Y-%m') AS f, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(last_day(o_orderdate) AS DATE) AS l FROM orders")
def fn_dates(spark, d):
    o = F.col("o_orderdate")
    day = o.cast("date")
    return Tables(spark, d).orders.select("o_orderkey", day.alias("d"), F.add_months(day, 3).alias("m"), F.date_diff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("n"), F.date_format(o, "yyyy-MM").alias("f"), F.quarter(o).cast("long").alias("q"), F.last_day(day).alias("l"))


@query("SELECT event_id, user_id % 2 = 0 AS even, CASE WHEN user_id % 2 = 0 THEN value * 2 ELSE -value END AS v FROM events")
def fn_user_scalar(spark, d):
    double = user.register_scalar(spark, "quern_signed", lambda v, u: v.where(u % 2 == 1, -2 * v) * -1, "double")
    return Tables(spark, d).events.select("event_id", (F.col("user_id") % 2 == 0).alias("even"), double("value", "user_id").alias("v"))


@query("SELECT r_regionkey, CAST(i AS INTEGER) AS i FROM region, range(0, 3) t(i) WHERE i < r_regionkey")
def fn_user_table(spark, d):
    user.register_table_function(spark, "quern_below", lambda n: ((i,) for i in range(min(n, 3))), "i int")
    Tables(spark, d).region.createOrReplaceTempView("quern_region")
    return spark.sql("SELECT r_regionkey, i FROM quern_region, LATERAL quern_below(r_regionkey)")


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_quantity < 5 AND o_orderstatus = 'F') OR (l_quantity > 45 AND o_orderstatus = 'O')")
def pred_or_over_join(spark, d):
    t = Tables(spark, d)
    q, s = F.col("l_quantity"), F.col("o_orderstatus")
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where(((q < 5) & (s == "F")) | ((q > 45) & (s == "O"))).agg(F.count(F.lit(1)).alias("n"))


def _scratch_file(spark, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey < 5")
def scan_csv(spark, d):
    customer, path = Tables(spark, d).customer, _scratch_file(spark, "csv")
    customer.write.csv(path, header=True)
    return sources.read_csv(spark, path, customer.schema).where("c_nationkey < 5").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json(spark, d):
    nation, path = Tables(spark, d).nation, _scratch_file(spark, "json")
    nation.write.json(path)
    return sources.read_json(spark, path, nation.schema).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT range AS id, range * range AS square FROM range(3, 1000, 7)")
def scan_range(spark, d):
    return spark.range(3, 1000, 7).select("id", (F.col("id") * F.col("id")).alias("square"))


@query("""SELECT id, k, last_value(k IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled,
  lag(k IGNORE NULLS) OVER (ORDER BY id) AS before FROM l""", ["l"])
def win_ignore_nulls(spark, d):
    w = Window.partitionBy(F.lit(0)).orderBy("id")
    return fixture(spark, "l").select("id", "k", F.last("k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("filled"), F.expr("lag(k) IGNORE NULLS OVER (PARTITION BY 0 ORDER BY id)").alias("before"))


@query("""SELECT event_id, CAST(element_at(m, 'b')[1] AS BIGINT) AS b, len(map_keys(m)) AS n FROM (
  SELECT event_id, MAP {'a': user_id, 'b': user_id + 1} AS m FROM events)""")
def fn_maps(spark, d):
    user = F.col("user_id")
    m = F.create_map(F.lit("a"), user, F.lit("b"), user + 1)
    return Tables(spark, d).events.select("event_id", F.element_at(m, "b").cast("long").alias("b"), F.size(F.map_keys(m)).cast("long").alias("n"))


@query("SELECT id, CAST(epoch_us(t) AS BIGINT) AS us, TRY_CAST(CAST(t AS VARCHAR) AS INTEGER) AS i, TRY_CAST('2024-02-' || (27 + id) AS DATE) AS day FROM ts", ["ts"])
def cast_temporal(spark, d):
    t = F.col("t")
    return fixture(spark, "ts").select("id", F.unix_micros(t.cast("timestamp")).alias("us"), F.expr("try_cast(cast(t AS string) AS int)").alias("i"), F.expr("try_cast('2024-02-' || (27 + id) AS date)").alias("day"))


@query("SELECT id, k, k IN (SELECT rk FROM r) AS mark, EXISTS (SELECT * FROM r WHERE rk > k + 1) AS theta, EXISTS (SELECT * FROM r WHERE rk IS NOT DISTINCT FROM k) AS safe FROM l", ["l", "r"])
def join_marks(spark, d):
    left, right = _lr(spark)
    keys = right.select("rk").distinct()
    facts = right.agg(F.max("rk").alias("most"), F.count(F.lit(1)).alias("n"), F.count("rk").alias("known"))
    # One row of facts decides the marks that aren't equal keys.
    hit = left.join(keys, F.col("k").eqNullSafe(F.col("rk")), "left_semi").select(F.col("id").alias("hit"))
    out = left.join(hit, F.col("id") == F.col("hit"), "left").join(F.broadcast(facts), F.lit(True))
    safe = F.col("hit").isNotNull()
    unknown = F.col("k").isNull() & (F.col("n") > 0) | ~safe & (F.col("n") > F.col("known"))
    return out.select("id", "k", F.when(unknown, F.lit(None).cast("boolean")).otherwise(safe).alias("mark"), F.coalesce(F.col("most") > F.col("k") + 1, F.lit(False)).alias("theta"), safe.alias("safe"))
