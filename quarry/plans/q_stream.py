"""Log frames, event frames and running counters, in batch and as streams."""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.plans.views import view, with_views
from quarry.sources import io as IO
from quarry.streaming import logs as L
from quarry.streaming import tail as T

BATCHES = 4                   # micro-batches that a replayed folder is read in
PERIOD = timedelta(days=5)    # of arrivals in one batch
HORIZON = "1 day"             # within which a line that comes again is a replay
WIDTH = 600                   # seconds of a window of the scoreboard

_D_PARSE = """
d AS (SELECT DISTINCT ON (stream_id, line_no) stream_id, line_no, value FROM log_frames),
p AS (SELECT stream_id, line_no,
             CASE WHEN starts_with(value, 'data:') THEN regexp_replace(substr(value, 6), '^\\s+|\\s+$', '', 'g')
                  ELSE regexp_replace(value, '^\\s+|\\s+$', '', 'g') END AS line
      FROM d WHERE value <> ''),
q AS (SELECT *, line = 'END_OF_LOG' AS is_end,
             CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN coalesce(
                  nullif(json_extract_string(line, '$.data'), ''), nullif(json_extract_string(line, '$.message'), ''),
                  nullif(json_extract_string(line, '$.text'), ''), line) ELSE line END AS payload
      FROM p),
stops AS (SELECT stream_id, MIN(line_no) AS stop FROM q WHERE is_end GROUP BY stream_id),
parsed AS (SELECT q.stream_id, q.line_no,
                  CASE WHEN is_end THEN '[stream] END_OF_LOG' ELSE regexp_replace(payload, '\\s+$', '') END AS text
           FROM q LEFT JOIN stops USING (stream_id) WHERE stop IS NULL OR line_no <= stop)"""


@query("log_frames_batch", oracle=with_views(f"WITH {_D_PARSE} SELECT * FROM parsed"))
def log_frames_batch(spark, sf_dir):
    """Parsed log lines per stream, batch twin (STR-1, STR-3)."""
    return L.log_lines_batch(view(spark, sf_dir, "log_frames"))


@query("log_dedupe", oracle=with_views("""
SELECT stream_id, COUNT(DISTINCT line_no) AS lines, COUNT(*) AS received FROM log_frames GROUP BY stream_id"""))
def log_dedupe(spark, sf_dir):
    """Lines per stream after dropping replayed duplicates (STR-3)."""
    lf = view(spark, sf_dir, "log_frames")
    d = lf.dropDuplicates(["stream_id", "line_no"]).groupBy("stream_id").agg(F.count(F.lit(1)).alias("lines"))
    r = lf.groupBy("stream_id").agg(F.count(F.lit(1)).alias("received"))
    return d.join(r, "stream_id")


def _source(spark, df, base, *by):
    """``df`` in files of a folder, in any order, as a stream of a few batches."""
    files = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = os.path.join(base, "in")
    T.write_files(df, path, files, *by)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // BATCHES)).parquet(path)


@query("log_frames_stream", oracle=with_views(f"WITH {_D_PARSE} SELECT * FROM parsed"))
def log_frames_stream(spark, sf_dir):
    """The log tail as a Structured Streaming job over shuffled files: the same
    rows as the batch twin (STR-1, STR-3)."""
    base = IO.scratch(spark, "logstream")
    src = _source(spark, view(spark, sf_dir, "log_frames"), base, "value", "line_no")
    out = os.path.join(base, "out")
    T.drain(T.tail_lines(src), os.path.join(base, "ckpt"), sink=out)
    return T.cut_at_end(spark.read.schema(T.LINES).parquet(out))


@query("log_dedupe_stream", oracle=with_views(f"""
SELECT stream_id, line_no, copy = 'far' AS again FROM log_arrivals WHERE copy <> 'near'"""))
def log_dedupe_stream(spark, sf_dir):
    """Lines that arrive again after a reconnect: dropped within the horizon,
    let through when they are later than any state is kept for (STR-3)."""
    a = view(spark, sf_dir, "log_arrivals").withColumn("arrived", F.col("arrived").cast("timestamp"))
    base = IO.scratch(spark, "dedupe")
    path = os.path.join(base, "in")
    days = a.agg(F.min("arrived").alias("lo"), F.max("arrived").alias("hi")).first()
    at, out = days["lo"], os.path.join(base, "out")
    while at is not None and at <= days["hi"]:  # what arrives in a period; the stream goes on from its checkpoint
        due = a.where((F.col("arrived") >= F.lit(at)) & (F.col("arrived") < F.lit(at + PERIOD)))
        T.write_files(due, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
        src = spark.readStream.schema(a.schema).parquet(path)
        T.drain(T.dedupe_within(src, ["stream_id", "line_no"], "arrived", HORIZON), os.path.join(base, "ckpt"), sink=out)
        at += PERIOD
    kept = spark.read.schema(a.schema).parquet(out) if at is not None else a
    return kept.select("stream_id", "line_no", (F.col("copy") == "far").alias("again"))


@query("sse_frames", oracle=with_views("""
WITH x AS (SELECT stream_id, line_no, line,
                  last_value(CASE WHEN starts_with(line, 'event:') THEN regexp_replace(substr(line, 7), '^\\s+|\\s+$', '', 'g') END IGNORE NULLS)
                    OVER (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event
           FROM sse_lines),
d AS (SELECT stream_id, line_no, event, regexp_replace(substr(line, 6), '^\\s+|\\s+$', '', 'g') AS raw FROM x
      WHERE starts_with(line, 'data:') AND event IN ('complete', 'error')),
f AS (SELECT stream_id, arg_min(event, line_no) AS event, arg_min(raw, line_no) AS raw FROM d GROUP BY stream_id),
ids AS (SELECT DISTINCT stream_id FROM sse_lines)
SELECT ids.stream_id, coalesce(f.event, 'closed') AS status,
       CASE WHEN f.event = 'complete' THEN coalesce(json_extract_string(f.raw, '$[0]'), '') END AS sql,
       CASE WHEN f.event = 'complete' THEN CAST(json_extract_string(f.raw, '$[2].row_count') AS BIGINT) END AS row_count,
       CASE WHEN f.event = 'error' THEN CASE WHEN f.raw <> '' AND f.raw <> 'null' THEN f.raw ELSE 'The model Space reported an error.' END
            WHEN f.event IS NULL THEN 'The Space closed the connection before returning a result.' END AS error
FROM ids LEFT JOIN f USING (stream_id)"""))
def sse_frames(spark, sf_dir):
    """One result per event stream (STR-2)."""
    return L.sse_results(view(spark, sf_dir, "sse_lines"))


_FINISHED = "1704067200 + example_id * 3 % 86400"  # seconds; a day of results


@query("scoreboard_stream", oracle=with_views(f"""
SELECT CAST(sec - sec % {WIDTH} AS BIGINT) AS window_start, kind, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE status = 'ok' AND executed) AS executed,
       COUNT(*) FILTER (WHERE status = 'ok' AND correct) AS correct,
       COUNT(*) FILTER (WHERE status = 'ok' AND repaired) AS repaired,
       ROUND(CAST(COUNT(*) AS DOUBLE) / {WIDTH}, 4) AS per_second
FROM (SELECT *, {_FINISHED} AS sec FROM e2e_results) GROUP BY ALL"""))
def scoreboard_stream(spark, sf_dir):
    """Executed / correct / repaired counters per kind and ten minutes of event
    time while results arrive, and examples per second; the last state of every
    window (STR-4)."""
    r = view(spark, sf_dir, "e2e_results").withColumn("finished", F.timestamp_seconds(F.expr(_FINISHED)))
    base = IO.scratch(spark, "scoreboard")
    src = _source(spark, r, base, "example_id")
    board = T.windowed_scoreboard(src, "finished", f"{WIDTH} seconds", horizon="2 days")
    sink = T.Upserts(os.path.join(base, "out"), ["window_start", "kind"])
    T.drain(board, os.path.join(base, "ckpt"), mode="update", upserts=sink)
    return sink.read(spark)
