"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quarry.session import checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Ship this package to the workers, and hand them texts in batches of
    bounded size: documents can be very long."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    prepare(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends there, lost executors lose nothing, and later reads prune columns.
    With ``clean`` the shuffle files that the write made are deleted at its end
    and not at some later collection of the driver's memory."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    was = spark.conf.get(_CLEAN)
    try:
        spark.conf.set(_CLEAN, str(clean or was == "true").lower())
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    return spark.read.schema(schema).parquet(path)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, renamed, so that extra columns never clash:
    ``pick(docs, doc_id="long", text="string")`` gives name and cast type."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in cols.items()])


def running_start(df: DataFrame, order: list[str], amount: str, out: str = "start") -> DataFrame:
    """``out``: the sum of ``amount`` over all rows before this one in the
    global ``order``.  Range partitions are ranked one by one and shifted by
    the sums of the partitions before them, so no task sees the whole table.
    ``order`` must identify rows, else ties fall in any order.
    """
    spark = df.sparkSession
    p = "_running_part"
    part = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(p, F.spark_partition_id())
    part = stage(part, "running")  # partition numbers must not change between the two uses
    within = Window.partitionBy(p).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted((r[0], int(r[1] or 0)) for r in part.groupBy(p).agg(F.sum(amount)).collect())
    base, total = [], 0  # one number per partition, not per row
    for i, s in sums:
        base.append((i, total))
        total += s
    shift = spark.createDataFrame(base, f"{p} int, _running_base long")
    return (part.withColumn(out, F.coalesce(F.sum(amount).over(within), F.lit(0)).cast("long"))
            .join(F.broadcast(shift), p)
            .withColumn(out, F.col(out) + F.col("_running_base")).drop(p, "_running_base"))


_HELD: list[Callable[[], None]] = []


def held(drop: Callable[[], None]) -> None:
    """``drop`` lets go of what a module remembers from task to task."""
    _HELD.append(drop)


def release(all_: bool = True) -> None:
    """Give memory that a Python worker no longer uses back to the system, with
    ``all_`` also what modules remember: workers are used again by other stages."""
    import ctypes

    import pyarrow as pa

    for drop in _HELD if all_ else ():
        drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """``run``, a function of ``mapInPandas``, between two releases."""
    def whole(batches):
        release()
        yield from run(batches)
        release()
    return whole


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- hashing
# 64-bit arithmetic wraps around on purpose.

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
held(_POWERS.clear)  # as long as the longest batch so far


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        have = _POWERS[base] = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
            for b in (base, inv))
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[s:e]`` for each pair, from one prefix sum of a
    polynomial: equal spans hash alike wherever they lie."""
    up, down = _powers(len(values) + 1, _ODD[which])
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(values: np.ndarray, gram: int, which: int = 0) -> np.ndarray:
    """``span_hashes`` of every ``gram`` consecutive values, without index arrays."""
    n = len(values) - gram + 1
    up, down = _powers(len(values) + 1, _ODD[which])
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:len(values)], out=total[1:])
    return mix((total[gram:] - total[:n]) * down[:n])


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[:len(m) - (w - have)], m[w - have:])
    return m
