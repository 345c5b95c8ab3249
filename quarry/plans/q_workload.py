"""The end-to-end query shapes of the reference's test suite and holdout,
re-aimed at the star schema (JN-6..8, JN-11, AGG-15, AGG-16, SRT-8/9,
SET-2..4, TXT-12, UPD-1, WIN-6, WIN-7).

Money is summed as DECIMAL (prices have two decimals) and cast to DOUBLE at
the end, so results do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources.tables import load

MONEY = "decimal(18,2)"


def _t(spark, sf_dir, name, *cols):
    df = load(spark, sf_dir, name)
    return df.select(*cols) if cols else df


def money_sum(c: str):
    return F.sum(F.col(c).cast(MONEY)).cast("double")


@query("e2e_sum_filtered", oracle="""
SELECT n.n_name, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'O' GROUP BY n.n_name""")
def e2e_sum_filtered(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus").where(
        F.col("o_orderstatus") == "O")
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .groupBy("n_name").agg(money_sum("o_totalprice").alias("revenue")))


@query("e2e_best_group", oracle="""
SELECT p.p_type FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_type ORDER BY SUM(CAST(l.l_quantity AS DECIMAL(18,2))) DESC, p.p_type LIMIT 1""")
def e2e_best_group(spark, sf_dir):
    # pre-aggregate lines per part before the join: the join then sees one
    # row per part instead of one per line
    li = (_t(spark, sf_dir, "lineitem", "l_partkey", "l_quantity")
          .groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast(MONEY)).alias("q")))
    p = _t(spark, sf_dir, "part", "p_partkey", "p_type")
    return (li.join(p, li.l_partkey == p.p_partkey).groupBy("p_type").agg(F.sum("q").alias("units"))
            .orderBy(F.desc("units"), F.asc("p_type")).limit(1).select("p_type"))


@query("e2e_count", oracle="SELECT COUNT(*) AS n FROM orders")
def e2e_count(spark, sf_dir):
    return _t(spark, sf_dir, "orders", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("e2e_total", oracle="SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def e2e_total(spark, sf_dir):
    return _t(spark, sf_dir, "orders", "o_totalprice").agg(money_sum("o_totalprice").alias("total"))


@query("e2e_distinct", oracle="SELECT DISTINCT c_mktsegment FROM customer")
def e2e_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "customer", "c_mktsegment").distinct()


@query("filter_sort", oracle="""
SELECT * FROM orders WHERE o_totalprice > 400000 ORDER BY o_totalprice DESC""")
def filter_sort(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.where(F.col("o_totalprice") > 400000).orderBy(F.desc("o_totalprice"))


@query("e2e_avg_sorted", oracle="""
SELECT event_type, ROUND(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 4) AS a
FROM events GROUP BY event_type ORDER BY a DESC""")
def e2e_avg_sorted(spark, sf_dir):
    ev = _t(spark, sf_dir, "events", "event_type", "value")
    return (ev.groupBy("event_type")
            .agg(F.round(money_sum("value") / F.count(F.lit(1)), 4).alias("a"))
            .orderBy(F.desc("a")))


@query("e2e_join_count", oracle="""
SELECT c.c_mktsegment, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment""")
def e2e_join_count(spark, sf_dir):
    # count orders per customer first, then join one row per customer
    o = _t(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return (o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment")
            .agg(F.sum("k").alias("n")))


@query("e2e_join_distinct", oracle="""
SELECT DISTINCT p.p_name FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey WHERE l.l_returnflag = 'R'""")
def e2e_join_distinct(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag").where(F.col("l_returnflag") == "R")
    p = _t(spark, sf_dir, "part", "p_partkey", "p_name")
    # semi join: a part with many returned lines is emitted once
    return p.join(li, p.p_partkey == li.l_partkey, "left_semi").select("p_name").distinct()


@query("e2e_multijoin_count", oracle="""
SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
def e2e_multijoin_count(spark, sf_dir):
    li = (_t(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("k")))
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    per_cust = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey")
                .agg(F.sum("k").alias("k")))
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    r = _t(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (per_cust.join(c, per_cust.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .groupBy("r_name").agg(F.sum("k").alias("n")))


@query("predicate_suite", oracle="""
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderdate > TIMESTAMP '1998-02-01 00:00:00'
  AND o_totalprice BETWEEN 100000 AND 300000
  AND o_orderstatus IN ('F', 'O')
  AND o_orderpriority LIKE '%URGENT%'
  AND o_custkey IS NOT NULL""")
def predicate_suite(spark, sf_dir):
    """Date after a month, BETWEEN, IN, LIKE, IS NOT NULL -- all pushed to the
    parquet scan (TXT-12)."""
    o = _t(spark, sf_dir, "orders")
    return (o.where((F.col("o_orderdate") > F.lit("1998-02-01 00:00:00").cast("timestamp_ntz"))
                    & F.col("o_totalprice").between(100000, 300000)
                    & F.col("o_orderstatus").isin("F", "O")
                    & F.col("o_orderpriority").like("%URGENT%")
                    & F.col("o_custkey").isNotNull())
            .select("o_orderkey", "o_orderpriority"))


@query("e2e_parts_by_size", oracle="SELECT p_name, p_size FROM part WHERE p_size < 10")
def e2e_parts_by_size(spark, sf_dir):
    return _t(spark, sf_dir, "part", "p_name", "p_size").where(F.col("p_size") < 10)


@query("e2e_nations_by_region", oracle="""
SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'""")
def e2e_nations_by_region(spark, sf_dir):
    n = _t(spark, sf_dir, "nation", "n_name", "n_regionkey")
    r = _t(spark, sf_dir, "region", "r_regionkey", "r_name").where(F.col("r_name") == "ASIA")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select("n_name")


@query("e2e_having", oracle="""
SELECT c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_name HAVING COUNT(*) > 1""")
def e2e_having(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_name")
    return (o.join(c, o.o_custkey == c.c_custkey).groupBy("c_name")
            .agg(F.sum("k").alias("k")).where(F.col("k") > 1).select("c_name"))


@query("e2e_having_distinct", oracle="""
SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS priorities FROM orders
GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderpriority) > 3""")
def e2e_having_distinct(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_custkey", "o_orderpriority")
    return (o.groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("priorities"))
            .where(F.col("priorities") > 3))


@query("e2e_group_stats", oracle="""
SELECT o_orderpriority, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 4) AS mean,
       MAX(o_totalprice) AS top
FROM orders GROUP BY o_orderpriority""")
def e2e_group_stats(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice")
    return o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), money_sum("o_totalprice").alias("total"),
        F.round(money_sum("o_totalprice") / F.count(F.lit(1)), 4).alias("mean"),
        F.max("o_totalprice").alias("top"))


@query("e2e_join_sum", oracle="""
SELECT n.n_name, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name""")
def e2e_join_sum(spark, sf_dir):
    o = (_t(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey")
         .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("s")))
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .groupBy("n_name").agg(F.sum("s").cast("double").alias("spend")))


@query("e2e_above_overall_avg", oracle="""
SELECT p_type FROM part GROUP BY p_type
HAVING SUM(CAST(p_retailprice AS DECIMAL(18,2))) / COUNT(*) >
       (SELECT SUM(CAST(p_retailprice AS DECIMAL(18,2))) / COUNT(*) FROM part)""")
def e2e_above_overall_avg(spark, sf_dir):
    """Group average above the overall average: uncorrelated scalar subquery
    in HAVING, planned as a join to a one-row aggregate (JN-11)."""
    p = _t(spark, sf_dir, "part", "p_type", "p_retailprice")
    price = F.col("p_retailprice").cast(MONEY)
    overall = p.agg((F.sum(price).cast("double") / F.count(F.lit(1))).alias("overall"))
    g = p.groupBy("p_type").agg((F.sum(price).cast("double") / F.count(F.lit(1))).alias("avg"))
    return g.crossJoin(F.broadcast(overall)).where(F.col("avg") > F.col("overall")).select("p_type")


@query("left_join_count", oracle="""
SELECT c.c_custkey, COUNT(o.o_orderkey) AS orders FROM customer c
LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def left_join_count(spark, sf_dir):
    """Left join with a count of the right side: customers without orders get
    0 (JN-7).  Orders are counted per customer before the join."""
    o = _t(spark, sf_dir, "orders", "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    c = _t(spark, sf_dir, "customer", "c_custkey")
    return (c.join(o, c.c_custkey == o.o_custkey, "left")
            .select("c_custkey", F.coalesce("k", F.lit(0)).cast("long").alias("orders")))


@query("anti_never_matched", oracle="""
SELECT c.c_custkey, c.c_name FROM customer c
LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c.c_custkey = o.o_custkey
WHERE o.o_orderkey IS NULL""")
def anti_never_matched(spark, sf_dir):
    """Customers that never placed an urgent order (LEFT JOIN .. IS NULL as an
    anti join, JN-8)."""
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_name")
    o = _t(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").where(
        F.col("o_orderpriority") == "1-URGENT")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


def _in_year(y: int):
    """A range of dates, which the scan can prune by; year() of the column it cannot."""
    day = F.col("o_orderdate")
    return (day >= F.lit(f"{y}-01-01").cast("date")) & (day < F.lit(f"{y + 1}-01-01").cast("date"))


def _cust_in_year(spark, sf_dir, y: int):
    o = _t(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    return o.where(_in_year(y)).select("o_custkey")


@query("set_intersect", oracle="""
SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995
INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998""")
def set_intersect(spark, sf_dir):
    return _cust_in_year(spark, sf_dir, 1995).intersect(_cust_in_year(spark, sf_dir, 1998))


@query("set_union", oracle="""
SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995
UNION SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998""")
def set_union(spark, sf_dir):
    return _cust_in_year(spark, sf_dir, 1995).union(_cust_in_year(spark, sf_dir, 1998)).distinct()


@query("set_except", oracle="""
SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995
EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998""")
def set_except(spark, sf_dir):
    return _cust_in_year(spark, sf_dir, 1995).subtract(_cust_in_year(spark, sf_dir, 1998))


@query("topk_limit", oracle="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def topk_limit(spark, sf_dir):
    """ORDER BY .. LIMIT k with a tie-break: TakeOrderedAndProject keeps k rows
    per task (SRT-8)."""
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).limit(5)


def _monthly(spark, sf_dir):
    o = _t(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    return (o.groupBy(F.date_trunc("month", "o_orderdate").alias("month"))
            .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("total"),
                 F.count(F.lit(1)).alias("n")))


@query("running_avg", oracle="""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
           FROM orders GROUP BY 1)
SELECT month, CAST(total AS DOUBLE) AS total,
       ROUND(CAST(SUM(total) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / COUNT(*) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running_avg
FROM m""")
def running_avg(spark, sf_dir):
    """Running average of monthly totals, frame ROWS UNBOUNDED PRECEDING ..
    CURRENT ROW (WIN-6).  The window runs on the monthly aggregate (one row
    per month), never on raw rows."""
    m = _monthly(spark, sf_dir)
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.select("month", F.col("total").cast("double").alias("total"),
                    F.round(F.sum("total").over(w).cast("double") / F.count(F.lit(1)).over(w), 4)
                    .alias("running_avg"))


@query("rank_of_aggregate", oracle="""
WITH s AS (SELECT c.c_nationkey, SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS spend
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey)
SELECT c_nationkey, CAST(spend AS DOUBLE) AS spend, RANK() OVER (ORDER BY spend DESC) AS rnk FROM s""")
def rank_of_aggregate(spark, sf_dir):
    """Global rank of an aggregate: aggregate first, then one small window (WIN-7)."""
    o = (_t(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey")
         .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("s")))
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    s = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.sum("s").alias("spend"))
    return s.select("c_nationkey", F.col("spend").cast("double").alias("spend"),
                    F.rank().over(Window.orderBy(F.desc("spend"))).cast("long").alias("rnk"))


@query("period_beats_period", oracle="""
SELECT n.n_name,
       CAST(SUM(CASE WHEN quarter(o.o_orderdate) = 4 THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS q4,
       CAST(SUM(CASE WHEN quarter(o.o_orderdate) = 3 THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS q3
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE year(o.o_orderdate) = 1997
GROUP BY n.n_name
HAVING SUM(CASE WHEN quarter(o.o_orderdate) = 4 THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END)
     > SUM(CASE WHEN quarter(o.o_orderdate) = 3 THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END)""")
def period_beats_period(spark, sf_dir):
    """Groups whose Q4 beat Q3: both periods as conditional sums (AGG-16)."""
    o = (_t(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
         .where(_in_year(1997)))
    c = _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation", "n_nationkey", "n_name")
    price = F.col("o_totalprice").cast(MONEY)

    def q(k):
        return F.sum(F.when(F.quarter("o_orderdate") == k, price).otherwise(F.lit(0).cast(MONEY)))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .groupBy("n_name").agg(q(4).alias("q4"), q(3).alias("q3"))
            .where(F.col("q4") > F.col("q3"))
            .select("n_name", F.col("q4").cast("double"), F.col("q3").cast("double")))


@query("conditional_update", oracle="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'F'
                        ELSE o_orderstatus END AS o_orderstatus
FROM orders""")
def conditional_update(spark, sf_dir):
    """UPDATE .. SET .. WHERE as a new frame (UPD-1); the source is not mutated."""
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    cond = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return o.select("o_orderkey", F.when(cond, F.lit("F")).otherwise(F.col("o_orderstatus"))
                    .alias("o_orderstatus"))


@query("conditional_delete", oracle="""
SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 50000)""")
def conditional_delete(spark, sf_dir):
    """DELETE .. WHERE as the complement filter (UPD-1)."""
    o = _t(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where(~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000))).select("o_orderkey")
