"""Streams against their batch twins, replays in and out of the horizon."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.plans import q_stream
from quarry.plans.views import view
from quarry.streaming import logs as L
from quarry.streaming import tail as T
from tests.conftest import SF


def test_stream_equals_batch(spark):
    b = q_stream.log_frames_batch(spark, SF)
    s = q_stream.log_frames_stream(spark, SF)
    assert b.count() > 0
    assert b.exceptAll(s).count() == 0 and s.exceptAll(b).count() == 0


def test_late_lines_and_a_late_end(spark, tmp_path):
    """Lines of earlier numbers, and an earlier end, that come in a later batch."""
    batches = [[(1, 700, "data: x"), (1, 2, "two"), (1, 9, "END_OF_LOG"), (2, 1, "END_OF_LOG"), (1, 2, "two")],
               [(1, 1, "one"), (1, 2, "two"), (1, 5, "END_OF_LOG"), (2, 7, "after"), (3, 4, ""), (3, 5, '{"data": "d "}')]]
    schema = "stream_id long, line_no long, value string"
    for rows in batches:
        T.write_files(spark.createDataFrame(rows, schema), str(tmp_path / "in"), 1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.drain(T.tail_lines(src), str(tmp_path / "ckpt"), sink=str(tmp_path / "out"))
    got = T.cut_at_end(spark.read.schema(T.LINES).parquet(str(tmp_path / "out")))
    all_ = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(1, 1, "one"), (1, 2, "two"), (1, 5, L.END_TEXT), (2, 1, L.END_TEXT), (3, 5, "d")}
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in L.log_lines_batch(all_).collect()} == want
    assert got.count() == 5


def test_replays_in_and_out_of_the_horizon(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 3, 1) + timedelta(days=d, hours=h)
    batches = [[(1, 1, day(0)), (1, 2, day(0))], [(1, 1, day(0, 5)), (1, 3, day(1))], [(1, 4, day(6))], [(1, 5, day(6, 1))],
               [(1, 1, day(7)), (1, 4, day(6, 2))]]
    schema = "stream_id long, line_no long, arrived timestamp"
    for rows in batches:
        T.write_files(spark.createDataFrame(rows, schema), str(tmp_path / "in"), 1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.drain(T.dedupe_within(src, ["stream_id", "line_no"], "arrived", "1 day"), str(tmp_path / "ckpt"), sink=str(tmp_path / "out"))
    got = sorted((r.line_no, r.arrived) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(1, day(0)), (1, day(7)), (2, day(0)), (3, day(1)), (4, day(6)), (5, day(6, 1))]


def test_scoreboard_totals_and_rerun_batches(spark, tmp_path):
    s = q_stream.scoreboard_stream(spark, SF)
    assert s.agg({"total": "sum"}).first()[0] == view(spark, SF, "e2e_results").count()
    sink = T.Upserts(str(tmp_path), ["k"])
    for batch, rows in ((0, [("a", 1), ("b", 1)]), (1, [("a", 2)]), (1, [("a", 3)])):  # batch 1 runs twice
        sink.write(spark.createDataFrame(rows, "k string, v long"), batch)
    assert sorted(map(tuple, sink.read(spark).collect())) == [("a", 3), ("b", 1)]


@pytest.mark.parametrize("block", [1, 2, 1 << 16])
def test_sse_carry_over(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    lines = [
        # stream 1: heartbeat data, then complete; the event name carries to a later frame
        (1, 1, "event: heartbeat"), (1, 2, 'data: {"p": 1}'), (1, 3, ""),
        (1, 4, "event: complete"), (1, 5, ""), (1, 9, 'data: ["SELECT 1", "md", {"row_count": 3}]'),
        # stream 2: error with a null payload
        (2, 1, "event: error"), (2, 2, "data: null"),
        # stream 3: data before any event, then nothing decisive
        (3, 1, 'data: {"p": 2}'), (3, 2, "event: heartbeat"), (3, 3, "data: x"),
        # stream 4: complete then a later error: the first decisive line wins
        (4, 1, "event: complete"), (4, 2, 'data: ["Q", "", {}]'), (4, 3, "event: error"), (4, 4, "data: boom"),
    ]
    df = spark.createDataFrame(lines, "stream_id long, line_no long, line string")
    got = {r.stream_id: (r.status, r.sql, r.row_count, r.error) for r in L.sse_results(df).collect()}
    assert got == {1: ("complete", "SELECT 1", 3, None), 2: ("error", None, None, L.ERROR_MSG),
                   3: ("closed", None, None, L.CLOSED_MSG), 4: ("complete", "Q", None, None)}
    plan = L.sse_results(df.select("*", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
