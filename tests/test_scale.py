"""Work is dealt by the size of the input, not by the files it lies in."""
import os
import re

from pyspark.sql import functions as F

from quarry.operators import catalog as K
from quarry.operators import generate as G
from quarry.plans import q_generate
from quarry.session import dealt
from quarry.sources import io as IO
from quarry.streaming import tail as T
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_gets_as_many_rows_as_asked(spark):
    few, many = dealt(spark.range(10, numPartitions=1), 100), dealt(spark.range(3000, numPartitions=1), 100)
    assert few.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert many.rdd.getNumPartitions() == 30


def test_groups_of_an_id_stay_with_its_seed(spark):
    for q in (q_generate.gen_gold, q_generate.gen_verified, q_generate.holdout_nonempty):
        assert "ENSURE_REQUIREMENTS" not in re.sub(r"BroadcastExchange.*", "", _plan(q(spark, SF)))


def test_checks_of_ids_that_come_twice_or_are_null(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long")
    s = G.seeds(ids, "id")
    g = G.gold(s, G.facts(s))
    rows = {r.gen_id: r["count"] for r in g.groupBy("gen_id").count().collect()}
    got = G.checks(s, g).collect()
    assert sorted(str(r.gen_id) for r in got) == ["1", "2", "2", "3", "None"]
    for r in got:
        assert r.rows == rows.get(r.gen_id, 0) * (2 if r.gen_id == 2 else 1)
        assert r.ok == (r.rows > 0 and r.pct_ok and r.rank_ok and r.topn_ok and r.sum_ok)


def test_records_are_made_by_many_tasks(spark):
    for q in (q_generate.gen_records, q_generate.gen_answers, q_generate.gen_strict):
        df = q(spark, SF)
        assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    # a filter on the answer's size would make every answer twice
    assert "Filter (size(" not in _plan(q_generate.gen_answers(spark, SF))


def test_grounding_stays_with_the_context(spark):
    q = spark.createDataFrame([
        (1, "a", "SELECT o.x, o.id, z.id FROM orders o JOIN items ON o.id = items.id"),
        (1, "b", "SELECT o.x"), (1, "b", "SELECT 1 FROM items o"),  # the texts of one query id count together
        (2, "a", "SELECT o.x FROM orders o"), (None, "a", "SELECT o.x FROM orders o"), (1, None, "SELECT o.x FROM orders o"), (1, "c", None),
    ], "context_id long, query_id string, sql string")
    cat = spark.createDataFrame([(1, "orders", "id"), (1, "items", "x"), (1, "third", "x"), (None, "orders", "id")], "context_id long, tbl string, col string")
    df = K.grounding_errors(q, cat)
    got = {tuple(r) for r in df.collect()}
    assert got == {(1, "a", "o", "orders", "x", "items, third"), (1, "a", "items", "items", "id", "orders")}
    kept = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", _plan(df))
    assert {k for _, k in kept} == {"REPARTITION_BY_NUM"}


def test_packed_json_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IO, "PART_ROWS", 40)
    df = spark.range(100, numPartitions=1).select(F.col("id").alias("example_id"), F.lit("long text " * 50).alias("sql_context"))
    plain, packed = str(tmp_path / "plain"), str(tmp_path / "packed")
    assert IO.write_jsonl(df, plain) == IO.write_jsonl(df, packed, compression="gzip") == 100
    size = lambda p: sum(os.path.getsize(os.path.join(p, f)) for f in os.listdir(p) if f.startswith("part"))
    assert size(packed) * 5 < size(plain) and len([f for f in os.listdir(packed) if f.startswith("part")]) == 3
    a, b = (IO.read_jsonl(spark, p, IO.EXAMPLE_SCHEMA) for p in (plain, packed))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and b.count() == 100


def test_lines_of_a_long_stream_share_a_key(spark, tmp_path):
    """A thousand lines are one or two keys of state, not one for every 512 numbers."""
    line = F.when(F.col("id") == 4000, "END_OF_LOG").otherwise(F.concat(F.lit("line "), F.col("id").cast("string")))
    rows = spark.range(0, 5000, 5).select(F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("line_no"), line.alias("value"))
    for part in (rows, rows.where("line_no % 2 = 0"), rows):
        T.write_files(part, str(tmp_path / "in"), 1)
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.drain(T.tail_lines(src), str(tmp_path / "ckpt"), sink=str(tmp_path / "out"))
    got = T.cut_at_end(spark.read.schema(T.LINES).parquet(str(tmp_path / "out"))).collect()
    assert sorted(r.line_no for r in got) == list(range(0, 4001, 5)) and 5000 // T.BLOCK <= 1
