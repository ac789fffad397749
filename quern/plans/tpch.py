"""The 22 decision-support queries over the tables at hand.

Columns that the tables lack are replaced: dates of commitment and receipt by
the ship date plus a few days of the part's number, ship modes and containers
by classes of the quantity and size, comments by priorities and names, and the
part-supplier table by the distinct pairs in lineitem with the least price as
the cost. Each query keeps its operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.tables import Tables

#: SQL of the derived part-supplier table.
PARTSUPP = """partsupp AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost,
         sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def partsupp(t: Tables, parts: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """Offers, of given parts (p_partkey) and suppliers (s_suppkey) only: others leave before the aggregation."""
    li = t.lineitem
    if parts is not None:
        li = li.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    if suppliers is not None:
        li = li.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return li.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("ps_supplycost"), F.sum("l_quantity").alias("ps_availqty"))


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def day(text: str):
    return F.lit(text).cast("timestamp_ntz")


def q1(spark, d):
    li = Tables(spark, d).lineitem.where(F.col("l_shipdate") <= day("1998-09-02"))
    charge = revenue() * (1 + F.col("l_tax"))
    out = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(revenue()), 2).alias("sum_disc_price"), F.round(F.sum(charge), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))
    return out.orderBy("l_returnflag", "l_linestatus")


Q1 = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
  round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


def q2(spark, d):
    t = Tables(spark, d)
    region = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = t.part.where("p_size <= 15").select("p_partkey")
    offers = partsupp(t, part, region.select("s_suppkey"))
    # The least cost by a window over the few offers that are left: one aggregation of lineitem.
    least = F.min("ps_supplycost").over(Window.partitionBy("ps_partkey"))
    offers = offers.withColumn("mc", least).where("ps_supplycost = mc")
    out = offers.join(region, F.col("ps_suppkey") == F.col("s_suppkey")).withColumnRenamed("ps_partkey", "p_partkey")
    return out.select("s_acctbal", "s_name", "n_name", "p_partkey").orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


Q2 = f"""WITH {PARTSUPP}, offers AS (
  SELECT * FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey FROM part JOIN offers o ON p_partkey = ps_partkey
WHERE p_size <= 15 AND ps_supplycost = (SELECT min(ps_supplycost) FROM offers i WHERE i.ps_partkey = p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100"""


def q3(spark, d):
    t = Tables(spark, d)
    out = t.customer.where("c_mktsegment = 'BUILDING'").join(t.orders.where(F.col("o_orderdate") < day("1995-03-15")), F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem.where(F.col("l_shipdate") > day("1995-03-15")), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)


Q3 = """SELECT l_orderkey, o_orderdate, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""


def q4(spark, d):
    t = Tables(spark, d)
    late = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")
    o = t.orders.where((F.col("o_orderdate") >= day("1997-07-01")) & (F.col("o_orderdate") < day("1997-10-01")))
    return o.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority")


Q4 = """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01'
  AND o_orderdate < TIMESTAMP '1997-10-01' AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority"""


def q5(spark, d):
    t = Tables(spark, d)
    home = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = t.orders.where((F.col("o_orderdate") >= day("1998-01-01")) & (F.col("o_orderdate") < day("1999-01-01")))
    out = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(home, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"))


Q5 = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY n_name"""


def q6(spark, d):
    li = Tables(spark, d).lineitem.where((F.col("l_shipdate") >= day("1998-01-01")) & (F.col("l_shipdate") < day("1999-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


Q6 = """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'
  AND l_shipdate < TIMESTAMP '1999-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""


def q7(spark, d):
    t = Tables(spark, d)
    n1 = t.nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("supp_nation"))
    n2 = t.nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("cust_nation"))
    both = ((F.col("supp_nation") == "NATION_3") & (F.col("cust_nation") == "NATION_7")) | ((F.col("supp_nation") == "NATION_7") & (F.col("cust_nation") == "NATION_3"))
    li = t.lineitem.where(F.col("l_shipdate").between(day("1995-01-01"), day("1996-12-31")))
    out = t.supplier.join(li, F.col("s_suppkey") == F.col("l_suppkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    out = out.join(n1, F.col("s_nationkey") == F.col("k1")).join(n2, F.col("c_nationkey") == F.col("k2")).where(both)
    return out.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("long").alias("l_year")).agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy("supp_nation", "cust_nation", "l_year")


Q7 = """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3'))
  AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY ALL"""


def q8(spark, d):
    t = Tables(spark, d)
    n1 = t.nation.join(t.region.where("r_name = 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k1"))
    n2 = t.nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("nation"))
    o = t.orders.where(F.col("o_orderdate").between(day("1995-01-01"), day("1996-12-31")))
    out = t.part.where("p_size < 10").join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n1, F.col("c_nationkey") == F.col("k1")).join(n2, F.col("s_nationkey") == F.col("k2"))
    share = F.sum(F.when(F.col("nation") == "NATION_2", revenue()).otherwise(0.0)) / F.sum(revenue())
    return out.groupBy(F.year("o_orderdate").cast("long").alias("o_year")).agg(F.round(share, 6).alias("mkt_share")).orderBy("o_year")


Q8 = """SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN n2.n_name = 'NATION_2' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
  / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
  JOIN nation n2 ON s_nationkey = n2.n_nationkey
WHERE r_name = 'AMERICA' AND p_size < 10 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY ALL"""


def q9(spark, d):
    t = Tables(spark, d)
    part = t.part.where(F.col("p_name").contains("ring")).select("p_partkey")
    out = part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    out = out.join(partsupp(t, part), (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey"))).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    profit = F.sum(revenue() - 0.5 * F.col("ps_supplycost") * F.col("l_quantity"))
    return out.groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").cast("long").alias("o_year")).agg(F.round(profit, 2).alias("sum_profit")).orderBy("nation", F.desc("o_year"))


Q9 = f"""WITH {PARTSUPP} SELECT n_name AS nation, year(o_orderdate) AS o_year,
  round(sum(l_extendedprice * (1 - l_discount) - 0.5 * ps_supplycost * l_quantity), 2) AS sum_profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN partsupp ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
  JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%ring%' GROUP BY ALL"""


def q10(spark, d):
    t = Tables(spark, d)
    o = t.orders.where((F.col("o_orderdate") >= day("1997-10-01")) & (F.col("o_orderdate") < day("1998-01-01")))
    out = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


Q10 = """SELECT c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""


def q11(spark, d):
    t = Tables(spark, d)
    home = partsupp(t).join(t.supplier, F.col("ps_suppkey") == F.col("s_suppkey")).join(t.nation.where("n_regionkey = 3"), F.col("s_nationkey") == F.col("n_nationkey"))
    value = F.sum(F.col("ps_supplycost") * F.col("ps_availqty"))
    total = home.agg((value * 0.001).alias("least"))
    out = home.groupBy("ps_partkey").agg(value.alias("v")).join(F.broadcast(total), F.col("v") > F.col("least"))
    return out.select("ps_partkey", F.round("v", 4).alias("value")).orderBy(F.desc("value"))


Q11 = f"""WITH {PARTSUPP}, home AS (SELECT * FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3)
SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 4) AS value FROM home GROUP BY ps_partkey
HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM home)"""


def q12(spark, d):
    t = Tables(spark, d)
    mode = F.when(F.col("l_quantity") < 10, "MAIL").when(F.col("l_quantity") < 20, "SHIP").otherwise("OTHER")
    li = t.lineitem.where((F.col("l_shipdate") >= day("1998-01-01")) & (F.col("l_shipdate") < day("1999-01-01"))).withColumn("l_shipmode", mode).where(F.col("l_shipmode").isin("MAIL", "SHIP"))
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    out = t.orders.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return out.groupBy("l_shipmode").agg(F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(~high, 1).otherwise(0)).alias("low_line_count")).orderBy("l_shipmode")


Q12 = """SELECT CASE WHEN l_quantity < 10 THEN 'MAIL' WHEN l_quantity < 20 THEN 'SHIP' ELSE 'OTHER' END AS l_shipmode,
  CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity < 20
  AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL"""


def q13(spark, d):
    t = Tables(spark, d)
    from quern.operators.aggregates import dense_count

    per = dense_count(t.customer, t.orders.where("o_orderpriority NOT LIKE '%URGENT%'"), "c_custkey", "o_custkey", "o_orderkey", "c_count")
    return per.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


Q13 = """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders
  ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) GROUP BY c_count"""


def q14(spark, d):
    t = Tables(spark, d)
    li = t.lineitem.where((F.col("l_shipdate") >= day("1995-09-01")) & (F.col("l_shipdate") < day("1995-10-01")))
    share = 100.0 * F.sum(F.when(F.col("p_type").startswith("PROMO"), revenue()).otherwise(0.0)) / F.sum(revenue())
    return li.join(t.part, F.col("l_partkey") == F.col("p_partkey")).agg(F.round(share, 6).alias("promo_revenue"))


Q14 = """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
  / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'"""


def q15(spark, d):
    t = Tables(spark, d)
    li = t.lineitem.where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1996-04-01")))
    per = li.groupBy(F.col("l_suppkey").alias("supplier_no")).agg(F.round(F.sum(revenue()), 2).alias("total_revenue"))
    best = per.agg(F.max("total_revenue").alias("best"))
    out = t.supplier.join(per, F.col("s_suppkey") == F.col("supplier_no")).join(best, F.col("total_revenue") == F.col("best"))
    return out.select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


Q15 = """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)"""


def q16(spark, d):
    t = Tables(spark, d)
    bad = t.supplier.where("s_acctbal < 0").select("s_suppkey")
    parts = t.part.where("p_brand <> 'Brand#45' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)")
    out = partsupp(t).join(parts, F.col("ps_partkey") == F.col("p_partkey")).join(bad, F.col("ps_suppkey") == F.col("s_suppkey"), "left_anti")
    return out.groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


Q16 = f"""WITH {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON ps_partkey = p_partkey
WHERE p_brand <> 'Brand#45' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size"""


def q17(spark, d):
    t = Tables(spark, d)
    parts = t.part.where("p_size < 20").select("p_partkey")
    own = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    mean = own.groupBy(F.col("l_partkey").alias("ak")).agg((0.4 * F.avg("l_quantity")).alias("low"))
    out = own.join(mean, (F.col("l_partkey") == F.col("ak")) & (F.col("l_quantity") < F.col("low")))
    return out.agg(F.round(F.sum("l_extendedprice") / 7.0, 2).alias("avg_yearly"))


Q17 = """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
WHERE p_size < 20 AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)"""


def q18(spark, d):
    t = Tables(spark, d)
    large = t.lineitem.groupBy(F.col("l_orderkey").alias("lk")).agg(F.sum("l_quantity").alias("q")).where("q > 250")
    out = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(large, F.col("o_orderkey") == F.col("lk"))
    return out.select("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", F.round("q", 2).alias("sum_qty")).orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


Q18 = """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
GROUP BY ALL ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"""


def q19(spark, d):
    t = Tables(spark, d)
    q, s, b = F.col("l_quantity"), F.col("p_size"), F.col("p_brand")
    hit = ((b == "Brand#12") & q.between(1, 11) & s.between(1, 15)) | ((b == "Brand#23") & q.between(10, 20) & s.between(1, 30)) | ((b == "Brand#34") & q.between(20, 30) & s.between(1, 45))
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).where(hit).agg(F.round(F.sum(revenue()), 2).alias("revenue"))


Q19 = """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)"""


def q20(spark, d):
    t = Tables(spark, d)
    parts = t.part.where("p_size < 25").select("p_partkey")
    sold = t.lineitem.where((F.col("l_shipdate") >= day("1998-01-01")) & (F.col("l_shipdate") < day("1999-01-01"))).groupBy("l_partkey", "l_suppkey").agg((0.5 * F.sum("l_quantity")).alias("half"))
    ps = partsupp(t).join(parts, F.col("ps_partkey") == F.col("p_partkey"), "left_semi").join(sold, (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey")) & (F.col("ps_availqty") > F.col("half")), "left_semi")
    home = t.supplier.join(t.nation.where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return home.join(ps, F.col("s_suppkey") == F.col("ps_suppkey"), "left_semi").select("s_suppkey", "s_name").orderBy("s_name")


Q20 = f"""WITH {PARTSUPP} SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND ps_availqty > (
    SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
      AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'))"""


def q21(spark, d):
    t = Tables(spark, d)
    li = t.lineitem.withColumn("late", F.col("l_returnflag") == "R")
    late = F.when(F.col("late"), F.col("l_suppkey"))
    # Are there several suppliers, and one late one? One plain aggregation instead of two self-joins.
    per = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"), F.min(late).alias("late_lo"), F.max(late).alias("late_hi"))
    only = per.where("lo < hi AND late_lo = late_hi").select(F.col("l_orderkey").alias("ok"))
    out = li.where("late").join(only, F.col("l_orderkey") == F.col("ok")).join(t.orders.where("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = out.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation.where("n_regionkey = 2"), F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("s_name").agg(F.count(F.lit(1)).alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(100)


Q21 = """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
  JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND n_regionkey = 2
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100"""


def q22(spark, d):
    t = Tables(spark, d)
    code = F.col("c_nationkey")
    some = t.customer.where(code.isin(13, 31, 23, 9, 0, 18, 17))
    mean = some.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = some.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean"))
    idle = rich.join(t.orders.where("o_orderdate >= timestamp_ntz '2000-06-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy(code.alias("cntrycode")).agg(F.count(F.lit(1)).alias("numcust"), F.round(F.sum("c_acctbal"), 2).alias("totacctbal")).orderBy("cntrycode")


Q22 = """SELECT c_nationkey AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_nationkey IN (13, 31, 23, 9, 0, 18, 17) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0
    AND c_nationkey IN (13, 31, 23, 9, 0, 18, 17))
  AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01') GROUP BY c_nationkey"""

QUERIES = {f"tpch_q{n}": globals()[f"q{n}"] for n in range(1, 23)}
SQL = {f"tpch_q{n}": globals()[f"Q{n}"] for n in range(1, 23)}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return q1(spark, folder)
