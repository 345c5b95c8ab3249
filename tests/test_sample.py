"""Global positions, quota sampling and splits: properties."""
import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import sample as S
from quarry.plans import q_sample
from tests.conftest import SF


def test_positions_equal_row_number(spark):
    df = spark.range(0, 5000).withColumn("k", S.shuffle_key(42, "id"))
    got = S.positions(df, ["k", "id"], n_parts=7).select("id", "pos")
    want = df.select("id", (F.row_number().over(Window.orderBy("k", "id")) - 1).alias("pos"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_shuffle_is_partition_count_invariant(spark):
    df = spark.range(0, 2000).withColumn("k", S.shuffle_key(42, "id"))
    a = S.positions(df.repartition(3), ["k", "id"], n_parts=4).select("id", "pos")
    b = S.positions(df.repartition(11), ["k", "id"], n_parts=9).select("id", "pos")
    assert a.exceptAll(b).count() == 0


def test_quota_sample_respects_quota_and_is_stable(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        a = q_sample.balanced(spark, SF)
        qs = {r["class"]: r.quota for r in q_sample.quotas(spark, SF).collect()}
        got = {r["class"]: r.n for r in a.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert all(got[c] <= qs[c] for c in got)
        assert a.select("example_id").distinct().count() == a.count()  # no row taken twice
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = q_sample.balanced(spark, SF)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_two_pass_fill_prefers_fair_share(spark):
    rows = ([(i, "A", "c", True) for i in range(10)] + [(100 + i, "B", "c", True) for i in range(2)])
    cands = spark.createDataFrame(rows, "example_id long, source string, class string, valid boolean")
    quotas = spark.createDataFrame([("c", 6)], "class string, quota long")
    out = S.quota_sample(cands, quotas, ["A", "B"], seed=1).collect()
    by_src = {}
    for r in out:
        by_src[r.source] = by_src.get(r.source, 0) + 1
    # fair share 3 each; B has only 2, A tops up to 4 in pass 2
    assert by_src == {"A": 4, "B": 2}
    assert sorted(r.k for r in out) == list(range(1, 7))


def test_splits_are_disjoint(spark):
    sp = q_sample._splits(spark, SF)
    assert sp.groupBy("example_id").count().where("count > 1").count() == 0
    assert sp.where("split = 'valid'").count() == min(q_sample.VAL_SIZE, sp.where("split <> 'test'").count())


def test_rank_in_groups_equals_window(spark):
    df = spark.range(0, 3000).withColumn("g", F.expr("nullif(id % 3, 2)")).withColumn("k", S.shuffle_key(7, "id"))
    a = S.rank_in_groups(df, ["g"], ["k", "id"], "p").select("id", "p")
    b = df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1).select("id", F.col("p").cast("long"))
    assert a.count() == 3000 and a.exceptAll(b).count() == 0
    assert S.rank_in_groups(df.where("id < 0"), ["g"], ["k", "id"], "p").count() == 0


def test_scan_cap(spark):
    """The cap counts a source's rows in shuffle order, valid or not; without
    it none is left out."""
    c = spark.range(0, 400).select(F.col("id").alias("example_id"), F.expr("if(id < 300, 'a', 'b')").alias("source"),
                                   F.lit("x").alias("class"), F.expr("id % 2 = 0").alias("valid"))
    q = spark.createDataFrame([("x", 1000)], "class string, quota long")
    assert S.quota_sample(c, q, ["a", "b"]).count() == 200
    got = {r[0] for r in S.quota_sample(c, q, ["a", "b"], scan_cap=50).select("example_id").collect()}
    want = set()
    for ids in (range(300), range(300, 400)):
        want |= {i for i in sorted(ids, key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())[:50] if i % 2 == 0}
    assert got == want
