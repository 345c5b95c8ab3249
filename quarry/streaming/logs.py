"""Log and event lines, as batches (STR-1..4); the streams are in ``tail``.

* ``parse_log_lines`` -- stateless parsing of one log line (Column
  expressions), shared by the batch and the streaming plan.
* ``log_lines_batch`` -- replayed duplicates dropped, each stream stopped at
  its first END_OF_LOG.
* ``sse_results`` -- server-sent-event frames to one result per stream.
* ``running_scoreboard`` -- counters per kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip

END = "END_OF_LOG"
END_TEXT = "[stream] END_OF_LOG"
CLOSED_MSG = "The Space closed the connection before returning a result."
ERROR_MSG = "The model Space reported an error."


def parse_log_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Blank lines dropped; ``data:`` prefix removed; JSON payload text from
    ``data``, ``message`` or ``text`` (first non-empty), else the line (STR-1)."""
    raw = F.col(value)
    line = F.when(raw.startswith("data:"), strip(F.substring(raw, 6, 1 << 30))).otherwise(strip(raw))
    payload = F.coalesce(*[F.nullif(F.get_json_object(line, f"$.{k}"), F.lit(""))
                           for k in ("data", "message", "text")], line)
    return (df.where(raw != "")
            .withColumn("is_end", line == END)
            .withColumn("text", F.when(F.col("is_end"), F.lit(END_TEXT))
                        .otherwise(F.regexp_replace(payload, r"\s+$", ""))))


def log_lines_batch(df: DataFrame) -> DataFrame:
    """(stream_id, line_no, value) -> (stream_id, line_no, text), up to and
    including each stream's first END_OF_LOG; replayed lines dropped (STR-3)."""
    p = parse_log_lines(df.dropDuplicates(["stream_id", "line_no"]))
    stops = p.where("is_end").groupBy("stream_id").agg(F.min("line_no").alias("stop"))
    return (p.join(stops, "stream_id", "left")
            .where(F.col("stop").isNull() | (F.col("line_no") <= F.col("stop")))
            .select("stream_id", "line_no", "text"))


BLOCK = 1 << 16  # lines of a stream that one task looks at together


def sse_results(lines: DataFrame) -> DataFrame:
    """(stream_id, line_no, line) -> one result per stream: the first data
    line under a ``complete`` or ``error`` event decides; the event name
    carries over to later frames (STR-2).

    A prefix scan in place of a window over a whole stream: within a block of
    lines the event carries over by a window, every block hands its last event
    on, and the first lines of a block take what the blocks before it hand
    over (one row a block).  No sort is global and nothing is stored.  Line
    numbers are unique within a stream."""
    ev = F.when(F.col("line").startswith("event:"), strip(F.substring("line", 7, 1 << 30)))
    x = (lines.select("stream_id", "line_no", "line", ev.alias("ev"), F.col("line").startswith("data:").alias("is_data"),
                      F.expr(f"line_no div {BLOCK}").alias("block"))
         .where(F.col("ev").isNotNull() | F.col("is_data")))
    within = Window.partitionBy("stream_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("own", F.last("ev", ignorenulls=True).over(within))
    handed = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (x.groupBy("stream_id", "block").agg(F.max_by("own", "line_no").alias("last"))
              .select("stream_id", "block", F.last("last", ignorenulls=True).over(handed).alias("carried")))
    decisive = (x.where("is_data").join(blocks, ["stream_id", "block"])
                .withColumn("event", F.coalesce("own", "carried")).where(F.col("event").isin("complete", "error"))
                .withColumn("raw", strip(F.substring("line", 6, 1 << 30))))
    first = decisive.groupBy("stream_id").agg(F.min_by(F.struct("event", "raw"), F.col("line_no")).alias("f"))
    ids = lines.select("stream_id").distinct()
    j = ids.join(first, "stream_id", "left")
    e, raw = F.col("f.event"), F.col("f.raw")
    return j.select(
        "stream_id",
        F.coalesce(e, F.lit("closed")).alias("status"),
        F.when(e == "complete", F.coalesce(F.get_json_object(raw, "$[0]"), F.lit(""))).alias("sql"),
        F.when(e == "complete", F.get_json_object(raw, "$[2].row_count").cast("long")).alias("row_count"),
        F.when(e == "error", F.when((raw != "") & (raw != "null"), raw).otherwise(F.lit(ERROR_MSG)))
        .when(e.isNull(), F.lit(CLOSED_MSG)).alias("error"))


def running_scoreboard(results: DataFrame) -> DataFrame:
    """Running counters per kind while cases arrive (STR-4)."""
    ok = F.col("status") == "ok"
    return results.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok & F.col("executed")).alias("executed"),
        F.count_if(ok & F.col("correct")).alias("correct"),
        F.count_if(ok & F.col("repaired")).alias("repaired"))
