"""Seeded shuffles, global positions, quota sampling and splits
(SRT-1..7, AGG-9, AGG-10, AGG-20, FLT-4, FLT-5, JN-2, SET-5).

Global order without one huge partition.  ``positions`` gives every row its
0-based place in a total order: range-partition on the order key, sort within
partitions, count rows per partition (one small row per partition), turn the
counts into offsets with a window over that tiny frame, and add the row's
index inside its partition.  No ``row_number() OVER (ORDER BY ..)`` over the
whole table (that is one task) and nothing passes through the driver.  The
tagged, range-partitioned frame is checkpointed once, so both of its readers
agree on partition ids.

Quota sampling never materialises buckets and ranks nothing globally: counts
per (class, source) decide both passes, and the rows come from cut keys
(``operators.counting``), so a hot class or source is spread over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import counting as C
from quarry.session import cut_lineage

MIN_SHARE = 0.03


def shuffle_key(seed: int, *ids) -> Column:
    """Seeded shuffle key: md5 of 'seed|id'.  Stable under repartitioning and
    equal to DuckDB's md5 (SRT-1)."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string")
                                  for c in ids]
    return F.md5(F.concat_ws("|", *parts))


def positions(df: DataFrame, order_cols: Sequence, pos: str = "pos",
              n_parts: int | None = None) -> DataFrame:
    """Add the 0-based global position of each row in ``order_cols`` order.

    The order must be total (add a unique tie-break column).
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # partition id and in-partition index are physical facts; they are
    # materialised once (reliable checkpoint in the shared folder) so that
    # the count branch and the join branch see the same rows in the same
    # places even if the input would be recomputed under another plan
    ranged = cut_lineage(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                         .withColumn("__pid", F.spark_partition_id())
                         .withColumn("__mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), "__pid")
            .withColumn(pos, (F.col("__off") + local).cast("long"))
            .drop("__pid", "__mid", "__off"))


def headroom_quotas(class_stats: DataFrame, total: Column) -> DataFrame:
    """Budget per class by headroom x frequency (AGG-20).

    w = max((1-acc)*share, MIN_SHARE*(1-acc)); quota = max(1, round_half_even(
    w * total / sum(w))).  ``total`` is a Column from a one-row frame joined in
    by the caller, or a literal.
    """
    w = F.greatest((1 - F.col("acc")) * F.col("share"), F.lit(MIN_SHARE) * (1 - F.col("acc")))
    cs = class_stats.withColumn("w", w)
    sw = Window.partitionBy(F.lit(1))  # 7-row parameter table
    scale = total.cast("double") / F.sum("w").over(sw)
    return cs.select("class", F.greatest(F.lit(1), F.bround(F.col("w") * scale, 0))
                     .cast("long").alias("quota"))


def group_positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                    pos: str = "pos") -> DataFrame:
    """0-based position of each row inside its group, in ``order_cols`` order.

    One global ``positions`` over (group, order) and the group's first
    position subtracted: a group holding a third of the rows is spread over
    many range partitions instead of one window task.
    """
    p = positions(df, list(group_cols) + list(order_cols), "__gp")
    starts = p.groupBy(*[F.col(c).alias(f"__g_{c}") for c in group_cols]).agg(F.min("__gp").alias("__g0"))  # one row per group
    same = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group_cols]
    return (p.join(starts, same).withColumn(pos, F.col("__gp") - F.col("__g0"))
            .drop("__gp", "__g0", *[f"__g_{c}" for c in group_cols]))


def rank_in_groups(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence,
                   pos: str = "pos") -> DataFrame:
    """0-based position inside each group (a null key is a group too), or in
    the whole frame when there are no group columns.  One plan at every size:
    range partitions share out a large group, and no task sorts it whole."""
    if group_cols:
        return group_positions(df, group_cols, order_cols, pos)
    return positions(df, order_cols, pos)


def quota_sample(cands: DataFrame, quotas: DataFrame, sources: Sequence[str],
                 seed: int = 42, scan_cap: int | None = None,
                 id_col: str = "example_id") -> DataFrame:
    """Two-pass quota fill (SRT-5, SRT-6, FLT-4).

    ``cands``: (id, source, class, valid) in any order.  Pass 1 caps each
    source at ceil(quota / n_sources) of every class; pass 2 tops a class up
    from any source in the listed order, taking only rows pass 1 did not take.
    With ``scan_cap`` a source scans at most so many rows in its shuffle order
    (valid or not); without it, all.  Returns (id, source, class, pass, k), k = place in the class bucket.

    Both passes are settled on counts per (class, source); a cut key per cell
    then selects the rows, and ``k`` is counted too (``operators.counting``).
    """
    chosen, takes = quota_rows(cands, quotas, sources, seed, scan_cap, id_col)
    cells = takes.groupBy("class", "source", "fair").agg(
        *[F.max(F.when(F.col("pass") == i, F.col("before"))).alias(f"before{i}") for i in (1, 2)])
    r = C.ranks(chosen, ["class", "source"], "skey", id_col, "r")
    x = r.join(F.broadcast(cells), ["class", "source"])  # one row per class and source
    first = F.col("r") <= F.col("fair")
    k = F.when(first, F.col("before1") + F.col("r")).otherwise(F.col("before2") + F.col("r") - F.col("fair"))
    return x.select(id_col, "source", "class", F.when(first, 1).otherwise(2).cast("int").alias("pass"),
                    k.cast("long").alias("k"))


def scanned(cands: DataFrame, seed: int, scan_cap: int | None, id_col: str = "example_id") -> DataFrame:
    """(id, source, class, valid, skey) of the rows that a harvest looks at,
    stored once: the counts and the cuts below read it again."""
    c = cut_lineage(cands.select(id_col, "source", "class", "valid", shuffle_key(seed, id_col).alias("skey")))
    if scan_cap is None:
        return c
    caps = c.groupBy("source").agg(F.lit(scan_cap).alias("take"))
    return C.first_rows(c, caps, ["source"], "skey", id_col)


def quota_rows(cands: DataFrame, quotas: DataFrame, sources: Sequence[str], seed: int = 42,
               scan_cap: int | None = None, id_col: str = "example_id") -> tuple[DataFrame, DataFrame]:
    """The rows a quota fill takes, with their shuffle key, and the takes per
    (class, source, pass)."""
    c = scanned(cands, seed, scan_cap, id_col).where(F.col("valid"))
    counts = c.groupBy("class", "source").agg(F.count(F.lit(1)).alias("n"))
    takes = cut_lineage(C.quota_takes(counts, quotas, sources))  # two rows a class and source
    cells = takes.groupBy("class", "source").agg(F.sum("take").alias("take"))
    return C.first_rows(c, cells, ["class", "source"], "skey", id_col), takes


def quota_fill(takes: DataFrame, quotas: DataFrame) -> DataFrame:
    """got / wanted per class and the exhausted flag (AGG-9), from the takes of
    ``counting.quota_takes``: no row is selected for it."""
    got = takes.groupBy("class").agg(F.sum("take").alias("got"))
    return (quotas.join(got, "class", "left")
            .select("class", "quota", F.coalesce("got", F.lit(0)).cast("long").alias("got"))
            .withColumn("exhausted", F.col("got") < F.col("quota")))
