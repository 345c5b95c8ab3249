"""Multi-level questions on the star schema (J7, WIN-1..5, JN-5, JN-9, JN-10).

Twin of the reference's e-commerce case: country = nation of the customer,
category = part type, revenue = quantity x price of lines whose order is
completed (``o_orderstatus = 'F'``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import multilevel as ml
from quarry.plans.registry import query
from quarry.sources.tables import load

MONEY = "decimal(18,2)"


def completed_cells(spark: SparkSession, sf_dir: str, status: str = "F") -> DataFrame:
    """(nation, category) cells: exact revenue (DECIMAL) and distinct customers.

    Two-stage plan.  Lines are joined to their (filtered) order and part and
    pre-aggregated to (customer, category) -- at most customers x categories
    rows, far fewer than lines -- before the customer -> nation lookup.  Each
    (customer, category) row is unique there, so the distinct-customer count
    of a cell is a plain count and needs no second distinct shuffle.
    """
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = (load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
         .select("o_orderkey", "o_custkey"))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    per_customer = (li.join(o, li.l_orderkey == o.o_orderkey)
                    .join(p, li.l_partkey == p.p_partkey)
                    .groupBy("o_custkey", "p_type")
                    .agg(F.sum(F.col("l_quantity").cast(MONEY)
                               * F.col("p_retailprice").cast(MONEY)).alias("rev")))
    return (per_customer.join(c, per_customer.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_name").alias("nation"), F.col("p_type").alias("category"))
            .agg(F.sum("rev").alias("revenue"), F.count("o_custkey").alias("customers")))


def priority_cells(spark: SparkSession, sf_dir: str, status: str = "F") -> DataFrame:
    """(nation, priority) cells over orders: exact sum of order totals."""
    o = (load(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
         .select("o_custkey", "o_orderpriority", "o_totalprice"))
    per_customer = (o.groupBy("o_custkey", "o_orderpriority")
                    .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("t")))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (per_customer.join(c, per_customer.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_name").alias("nation"),
                     F.col("o_orderpriority").alias("priority"))
            .agg(F.sum("t").alias("amount")))


def _money_out(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


_CELLS_SQL = """
SELECT n.n_name AS nation, p.p_type AS category,
       SUM(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2))) AS revenue,
       COUNT(DISTINCT o.o_custkey) AS customers
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
WHERE o.o_orderstatus = 'F'
GROUP BY n.n_name, p.p_type"""

_PRIO_SQL = """
SELECT n.n_name AS nation, o.o_orderpriority AS priority,
       SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS amount
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'F'
GROUP BY n.n_name, o.o_orderpriority"""


@query("ml_base", oracle=f"""
WITH a AS ({_CELLS_SQL})
SELECT nation, category, CAST(revenue AS DOUBLE) AS revenue, customers FROM a""")
def ml_base(spark, sf_dir):
    return _money_out(completed_cells(spark, sf_dir), "revenue")


@query("ml_share", oracle=f"""
WITH a AS ({_CELLS_SQL})
SELECT nation, category, CAST(revenue AS DOUBLE) AS revenue,
       ROUND(CAST(revenue AS DOUBLE) * 100.0 / CAST(SUM(revenue) OVER (PARTITION BY nation) AS DOUBLE), 4) AS pct
FROM a""")
def ml_share(spark, sf_dir):
    cells = completed_cells(spark, sf_dir)
    out = ml.with_share(cells, "nation", "revenue", "pct")
    return _money_out(out.select("nation", "category", "revenue", "pct"), "revenue")


@query("ml_rank", oracle=f"""
WITH a AS ({_CELLS_SQL})
SELECT nation, category, CAST(revenue AS DOUBLE) AS revenue,
       RANK() OVER (PARTITION BY nation ORDER BY revenue DESC) AS rnk
FROM a""")
def ml_rank(spark, sf_dir):
    cells = completed_cells(spark, sf_dir)
    out = ml.with_rank(cells, "nation", "revenue", "rnk")
    return _money_out(out.select("nation", "category", "revenue", "rnk"), "revenue")


ML_TOPN_SQL = f"""
WITH a AS ({_CELLS_SQL}),
b AS (
  SELECT *, ROUND(CAST(revenue AS DOUBLE) * 100.0 / CAST(SUM(revenue) OVER (PARTITION BY nation) AS DOUBLE), 4) AS pct,
         RANK() OVER (PARTITION BY nation ORDER BY revenue DESC) AS rnk
  FROM a)
SELECT nation, category, CAST(revenue AS DOUBLE) AS revenue, customers, pct, rnk
FROM b WHERE rnk <= 2"""


def ml_topn_df(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    cells = completed_cells(spark, sf_dir)
    out = ml.top_n(cells, "nation", "revenue", n, rnk="rnk", pct="pct")
    return _money_out(out.select("nation", "category", "revenue", "customers", "pct", "rnk"),
                      "revenue")


@query("ml_topn", oracle=ML_TOPN_SQL, bench=True)
def ml_topn(spark, sf_dir):
    return ml_topn_df(spark, sf_dir, 2)


@query("ml_top1_rank", oracle=f"""
WITH a AS ({_CELLS_SQL}),
b AS (SELECT *, RANK() OVER (PARTITION BY nation ORDER BY revenue DESC) AS k FROM a)
SELECT nation, category, CAST(revenue AS DOUBLE) AS revenue FROM b WHERE k = 1""")
def ml_top1_rank(spark, sf_dir):
    out = ml.top1_rank(completed_cells(spark, sf_dir), "nation", "revenue")
    return _money_out(out.select("nation", "category", "revenue"), "revenue")


@query("ml_top1_correlated", oracle=f"""
WITH a AS ({_PRIO_SQL})
SELECT nation, priority, CAST(amount AS DOUBLE) AS amount FROM a t
WHERE amount = (SELECT MAX(amount) FROM a u WHERE u.nation = t.nation)""")
def ml_top1_correlated(spark, sf_dir):
    out = ml.top1_max(priority_cells(spark, sf_dir), "nation", "amount")
    return _money_out(out.select("nation", "priority", "amount"), "amount")


@query("ml_above_avg_window", oracle=f"""
WITH a AS ({_CELLS_SQL}),
m AS (SELECT *, AVG(revenue) OVER (PARTITION BY nation) AS av FROM a)
SELECT nation, category, CAST(revenue AS DOUBLE) AS revenue FROM m WHERE revenue > av""")
def ml_above_avg_window(spark, sf_dir):
    out = ml.above_group_avg(completed_cells(spark, sf_dir), "nation", "revenue")
    return _money_out(out.select("nation", "category", "revenue"), "revenue")


@query("ml_above_avg_correlated", oracle=f"""
WITH a AS ({_PRIO_SQL})
SELECT nation, priority, CAST(amount AS DOUBLE) AS amount FROM a t
WHERE amount > (SELECT AVG(amount) FROM a u WHERE u.nation = t.nation)""")
def ml_above_avg_correlated(spark, sf_dir):
    out = ml.above_group_avg(priority_cells(spark, sf_dir), "nation", "amount")
    return _money_out(out.select("nation", "priority", "amount"), "amount")
