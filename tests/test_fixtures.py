"""Hand-computed answers (FIXTURES.md) for the core operators."""
import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import counting as C
from quarry.operators import multilevel as ml
from quarry.operators import report as R
from quarry.operators import sample as S

# -- fixture rows: a small shop (customers, products, orders) ------------------
CUSTOMERS = [(1, "India"), (2, "USA"), (3, "India"), (4, "UK")]
PRODUCTS = [(1, "Electronics", 800.0), (2, "Electronics", 500.0), (3, "Accessories", 100.0),
            (4, "Accessories", 75.0)]
ORDERS = [(101, 1, 1, 2, "completed"), (102, 2, 2, 1, "completed"), (103, 1, 3, 3, "completed"),
          (104, 3, 1, 1, "cancelled"), (105, 4, 4, 2, "completed"), (106, 3, 2, 2, "completed"),
          (107, 2, 3, 1, "completed")]


def _cells(spark):
    c = spark.createDataFrame(CUSTOMERS, "customer_id long, country string")
    p = spark.createDataFrame(PRODUCTS, "product_id long, category string, price double")
    o = spark.createDataFrame(ORDERS, "order_id long, customer_id long, product_id long, quantity long, status string")
    f = o.where(F.col("status") == "completed").join(c, "customer_id").join(p, "product_id")
    return ml.group_measure(f, ["country", "category"],
                            F.col("quantity").cast("decimal(18,2)") * F.col("price").cast("decimal(18,2)"),
                            total="revenue", distinct_of="customer_id", uniques="customers")


def test_topn_share_rank_ecom(spark):
    out = ml.top_n(_cells(spark), "country", "revenue", 2).collect()
    got = {(r.country, r.category): (float(r.revenue), r.customers, r.pct, r.rnk) for r in out}
    assert got == {
        ("India", "Electronics"): (2600.0, 2, 89.6552, 1),
        ("India", "Accessories"): (300.0, 1, 10.3448, 2),
        ("USA", "Electronics"): (500.0, 1, 83.3333, 1),
        ("USA", "Accessories"): (100.0, 1, 16.6667, 2),
        ("UK", "Accessories"): (150.0, 1, 100.0, 1),
    }


def test_shares_sum_to_100(spark):
    s = ml.with_share(_cells(spark), "country", "revenue").groupBy("country").agg(F.sum("pct").alias("t"))
    for r in s.collect():
        assert abs(r.t - 100) < 1e-3


def test_top1_and_above_avg_forms_agree(spark):
    cells = _cells(spark)
    a = {tuple(r) for r in ml.top1_rank(cells, "country", "revenue").select("country", "category").collect()}
    b = {tuple(r) for r in ml.top1_max(cells, "country", "revenue").select("country", "category").collect()}
    assert a == b == {("India", "Electronics"), ("USA", "Electronics"), ("UK", "Accessories")}
    w = {tuple(r) for r in ml.above_group_avg_window(cells, "country", "revenue").select("country", "category").collect()}
    j = {tuple(r) for r in ml.above_group_avg(cells, "country", "revenue").select("country", "category").collect()}
    assert w == j


CLASS_STATS = [("basic SQL", 0.885, 0.550), ("aggregation", 0.704, 0.237), ("single join", 0.632, 0.127),
               ("subqueries", 0.692, 0.043), ("window functions", 0.300, 0.033),
               ("multiple_joins", 0.500, 0.007), ("set operations", 0.500, 0.003)]


@pytest.mark.parametrize("total,expected", [
    (4200, [1078, 1195, 796, 226, 394, 256, 256]),
    (20200, [5184, 5749, 3830, 1085, 1893, 1229, 1229]),
])
def test_headroom_quotas(spark, total, expected):
    cs = spark.createDataFrame(CLASS_STATS, "class string, acc double, share double")
    q = {r["class"]: r.quota for r in S.headroom_quotas(cs, F.lit(total)).collect()}
    assert [q[c] for c, _, _ in CLASS_STATS] == expected


@pytest.mark.parametrize("b,c,p", [(10, 6, 0.4544983), (29, 12, 0.0115078), (0, 0, 1.0), (5, 5, 1.0)])
def test_mcnemar_exact(spark, b, c, p):
    bc = spark.createDataFrame([("x", b, c)], "run string, b long, c long")
    got = R.mcnemar_exact(bc).first().p_value
    assert math.isclose(got, p, abs_tol=1e-6)


def test_mcnemar_large_n_log_space(spark):
    bc = spark.createDataFrame([("x", 30000, 29000)], "run string, b long, c long")
    got = R.mcnemar_exact(bc).first().p_value
    assert 0 < got < 1e-4 or got == 0.0


def test_standard_error(spark):
    rows = [(i, "r", "c", True, i < 248, False) for i in range(300)]  # 248/300 = 0.8267
    o = spark.createDataFrame(rows, "example_id long, run string, class string, runs boolean, exec_ok boolean, exact boolean")
    r = R.accuracy_se(o).first()
    assert math.isclose(r.se, math.sqrt((248 / 300) * (52 / 300) / 300), abs_tol=1e-6)
    assert math.isclose(math.sqrt(0.827 * 0.173 / 300), 0.0218381, abs_tol=1e-6)


def test_percentile_rule(spark):
    v = spark.createDataFrame([(x,) for x in [5, 3, 1, 4, 2]], "len long")
    r = C.value_picks(v, "len", [0.5]).first()
    assert r.p50 == 2 and r["max"] == 5 and r.n == 5
