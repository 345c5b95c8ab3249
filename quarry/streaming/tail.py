"""Streams of log lines: tail, replays, and counters while results arrive
(STR-1, STR-3, STR-4).

* ``tail_lines`` -- lines in any order, each once: state by (stream, block of
  lines), so that one long stream is shared by many tasks.  A block remembers
  which of its lines came and its first END_OF_LOG; it forgets both when no
  line came for a while.  ``cut_at_end`` ends every stream at its first
  END_OF_LOG when the lines are read.
* ``dedupe_within`` -- duplicates within a horizon of event time, natively; the
  state of a line expires with the watermark.
* ``windowed_scoreboard`` -- counters by event-time window, in update mode.
* ``Upserts`` -- a sink of changed rows: a folder for each batch, written whole,
  so that a batch that runs again replaces its own rows; the last batch of a
  key counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.logs import parse_log_lines

BLOCK = 1 << 13  # lines whose arrival one key remembers, a bit each
IDLE = 6 * 3600  # seconds; a block without new lines forgets after this time
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINES = "stream_id long, line_no long, text string, is_end boolean"


class _Block(StatefulProcessor):
    """Lines of one block that have not come before, up to its first end."""

    def __init__(self, idle: int):
        self.idle_ms = idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("block", "seen binary, stop long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, stop, timer = self.state.get() if self.state.exists() else (None, None, None)
        bits = np.frombuffer(seen or bytes(BLOCK // 8), np.uint8)
        bits = np.unpackbits(bits, bitorder="little").astype(bool)
        x = pd.concat(list(rows), ignore_index=True)
        now = int(x["arrived"].max().timestamp() * 1000)
        x["bit"] = x["line_no"] % BLOCK
        x = x[~bits[x["bit"].to_numpy()]].drop_duplicates("bit")
        bits[x["bit"].to_numpy()] = True
        ends = x.loc[x["is_end"], "line_no"]
        if len(ends):
            stop = int(ends.min()) if stop is None else min(stop, int(ends.min()))
        out = x if stop is None else x[x["line_no"] <= stop]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = now + self.idle_ms
        self.handle.registerTimer(timer)
        self.state.update((np.packbits(bits, bitorder="little").tobytes(), stop, timer))
        yield out[["stream_id", "line_no", "text", "is_end"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"stream_id": [], "line_no": [], "text": [], "is_end": []})

    def close(self) -> None:
        pass


def tail_lines(stream: DataFrame, idle: int = IDLE) -> DataFrame:
    """(stream_id, line_no, value) of a stream, in any order and with replays,
    to (stream_id, line_no, text, is_end), every line once (STR-1, STR-3).

    Time is the time of arrival, so no line is late, whatever its number.  A
    line that comes again after its block was idle for ``idle`` seconds comes
    out again; null ids or numbers give nothing.  Needs the RocksDB state store."""
    stream.sparkSession.conf.set(STORE, ROCKS)
    p = parse_log_lines(stream).where("stream_id is not null and line_no is not null")
    p = p.select("stream_id", "line_no", "text", "is_end", F.expr(f"line_no div {BLOCK}").alias("block"), F.current_timestamp().alias("arrived"))
    return p.withWatermark("arrived", "0 seconds").groupBy("stream_id", "block").transformWithStateInPandas(
        statefulProcessor=_Block(idle), outputStructType=LINES, outputMode="Append", timeMode="EventTime")


def cut_at_end(lines: DataFrame) -> DataFrame:
    """(stream_id, line_no, text) up to each stream's first END_OF_LOG."""
    stops = lines.where("is_end").groupBy("stream_id").agg(F.min("line_no").alias("stop"))
    return (lines.join(stops, "stream_id", "left").where("stop is null or line_no <= stop")
            .select("stream_id", "line_no", "text"))


def dedupe_within(stream: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """Rows of ``stream`` without those that repeat ``keys`` within ``horizon``
    of event time (STR-3).  A replay later than that comes through, as its
    first copy is forgotten: state does not grow with the length of a stream.
    Rows behind the watermark by more than ``horizon`` are dropped."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_scoreboard(results: DataFrame, time: str, width: str, horizon: str = "10 minutes") -> DataFrame:
    """Counters per kind and event-time window, and examples per second
    (STR-4).  On a stream: update mode, a window's state goes ``horizon``
    after its end."""
    ok = F.col("status") == "ok"
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    counts = results.withWatermark(time, horizon) if results.isStreaming else results
    return (counts.groupBy(F.window(time, width).alias("w"), "kind")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(ok & F.col("executed")).alias("executed"),
                 F.count_if(ok & F.col("correct")).alias("correct"),
                 F.count_if(ok & F.col("repaired")).alias("repaired"))
            .select(F.unix_timestamp("w.start").alias("window_start"), "kind", "total", "executed", "correct", "repaired",
                    F.round(F.col("total") / seconds, 4).alias("per_second")))


class Upserts:
    """Sink of changed rows by key, and its reader."""

    def __init__(self, path: str, keys: list[str]):
        self.path, self.keys = path, keys

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(self.path, f"batch={batch_id}"))

    def read(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path)
        values = [c for c in rows.columns if c not in (*self.keys, "batch")]
        last = F.max_by(F.struct(*values), "batch").alias("_last")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, "_last.*")


def drain(stream: DataFrame, checkpoint: str, mode: str = "append", sink: str | None = None,
          upserts: Upserts | None = None) -> None:
    """Run a stream until its source is read up: to Parquet files in ``sink``
    or to ``upserts``."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(upserts.write) if upserts else w.format("parquet").option("path", sink)).start()
    q.awaitTermination()


def write_files(df: DataFrame, path: str, files: int, *by: str) -> None:
    """A folder of ``files`` files that a file source replays; rows are dealt
    by a hash of ``by``, so their order is lost."""
    df.repartition(files, *[F.xxhash64(*by)] if by else []).write.mode("append").parquet(path)
