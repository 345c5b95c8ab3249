"""Selection and ranks by counting, against windows over whole groups."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import counting as C
from quarry.operators import sample as S


def rows(spark, n=3000):
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(n).select("id", g.alias("g"), S.shuffle_key(1, F.col("id") % 2500).alias("key"))  # keys repeat


@pytest.mark.parametrize("widths", [(1,), (1, 1), (3, 2)])
def test_ranks_equal_row_number(spark, widths):
    df = rows(spark)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("key", "id")).cast("long"))
    got = C.ranks(df, ["g"], "key", "id", widths=widths).select(want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


@pytest.mark.parametrize("widths", [(1,), (1, 1), (3, 2)])
def test_first_rows_equal_a_window(spark, widths):
    df = rows(spark)
    takes = [("hot", 137), (None, 5), ("g0", 10_000), ("g1", 0), ("g2", 1), ("not there", 3)]
    t = spark.createDataFrame(takes, "g string, take long")
    w = F.row_number().over(Window.partitionBy("g").orderBy("key", "id"))
    want = {(r.g, r.id) for r in df.withColumn("r", w).collect() if r.r <= dict(takes).get(r.g, 0)}
    got = C.first_rows(df, t, ["g"], "key", "id", widths)
    assert got.columns == df.columns
    found = [(r.g, r.id) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_first_rows_of_one_group(spark):
    df = rows(spark)
    t = spark.createDataFrame([(200,)], "take long")
    got = {r.id for r in C.first_rows(df, t, [], "key", "id").collect()}
    assert got == {r.id for r in df.orderBy("key", "id").limit(200).collect()}
    assert C.first_rows(df.where("false"), t, [], "key", "id").count() == 0


def test_no_global_sort_in_the_quota_fill(spark):
    r = random.Random(3)
    cands = spark.createDataFrame([(i, r.choice("ab"), r.choice("xyz"), r.random() < .9) for i in range(500)],
                                  "example_id long, source string, class string, valid boolean")
    quotas = spark.createDataFrame([("x", 20), ("y", 500)], "class string, quota long")
    out = S.quota_sample(cands, quotas, ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan
    ks = {}
    for x in out.collect():
        ks.setdefault(x["class"], []).append(x.k)
    assert sorted(ks["x"]) == list(range(1, 21)) and sorted(ks["y"]) == list(range(1, len(ks["y"]) + 1))


def test_takes_cut_the_last_source_of_a_full_class(spark):
    counts = spark.createDataFrame([("c", "A", 10), ("c", "B", 10), ("c", "C", 10), ("d", "A", 1), ("d", "C", 9)],
                                   "class string, source string, n long")
    quotas = spark.createDataFrame([("c", 7), ("d", 6)], "class string, quota long")
    got = {(r["class"], r.source, r["pass"]): r.take for r in C.quota_takes(counts, quotas, ["A", "B", "C"]).collect()}
    assert [got["c", s, 1] for s in "ABC"] == [3, 3, 1] and all(got["c", s, 2] == 0 for s in "ABC")
    assert [got["d", s, p] for s, p in (("A", 1), ("C", 1), ("A", 2), ("C", 2))] == [1, 2, 0, 3]


@pytest.mark.parametrize("wide", [1, 1_000_003])
def test_value_picks(spark, wide):
    r = random.Random(6)
    values = [r.choice([0, 3, 7, 700]) * wide + r.randint(0, 3) for _ in range(777)] + [-5, 2047, 2048]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "len int")
    got = C.value_picks(df, "len", [0.0, 0.5, 0.9, 0.99]).first()
    s = sorted(values)
    assert (got.n, got.max) == (780, s[-1])
    assert [got.p0, got.p50, got.p90, got.p99] == [s[max(1, int(780 * p)) - 1] for p in (0, 0.5, 0.9, 0.99)]
    assert C.value_picks(df.where("false"), "len", [0.5]).count() == 0
