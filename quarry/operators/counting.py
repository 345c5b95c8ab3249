"""Selection and ranks from counts (SRT-3..7, AGG-9, AGG-10).

The first n rows of a group in the order of a uniform key, such as a digest in
hexadecimal, need no sort: counts per key prefix tell in which prefix the cut
lies, counts of that prefix's longer prefixes tell it more closely, and rows
before the cut are taken by a filter.  Only the rows of the last prefix, one in
``16 ** sum(WIDTHS)`` of a group, are put in order.  Places of rows come the
same way: rows of all smaller prefixes, and the place among those that share
the longest one.  Groups are never brought together in one task, and every
plan is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTHS = (3, 2)  # hexadecimal digits by which each level makes the prefix longer


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``cols``, a null equal to itself; the columns of both, once."""
    if not cols:
        return left.crossJoin(right)  # the right side is one row then
    other = right.select([F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in cols])
    return left.join(other, on, how).drop(*[f"_r_{c}" for c in cols])


def _before(cols: Sequence[str], order: str) -> Column:
    """Rows counted in the prefixes before this one."""
    w = Window.partitionBy(*cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_n").over(w), F.lit(0))


def first_rows(df: DataFrame, takes: DataFrame, group_cols: Sequence[str], key: str, tie: str,
               widths: Sequence[int] = WIDTHS) -> DataFrame:
    """The first ``take`` rows of each group by (``key``, ``tie``).

    ``takes``: one row per group with ``take``, a parameter table (it is
    broadcast); rows of a group it lacks go.  ``key``: hexadecimal digits of a
    hash, never null.  (``key``, ``tie``) must tell rows of a group apart.
    """
    group = list(group_cols)
    at = takes.select(*group, F.col("take").cast("long").alias("_need")).where("_need > 0")
    reached = list(group)
    for level in range(len(widths)):
        prefix = f"_p{level}"
        df = df.withColumn(prefix, F.substring(key, 1, sum(widths[:level + 1])))
        counts = (_same(df, F.broadcast(at), reached).groupBy(*reached, prefix)
                  .agg(F.count(F.lit(1)).alias("_n"), F.first("_need").alias("_need")))
        counts = counts.withColumn("_before", _before(reached, prefix))  # at most 16 ** width rows a window
        if level == 0:  # a group may have fewer rows than it may give
            counts = counts.withColumn("_need", F.least("_need", F.sum("_n").over(Window.partitionBy(*reached))))
        hit = (F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_before") + F.col("_n"))
        at = counts.where(hit).select(*reached, prefix, (F.col("_need") - F.col("_before")).alias("_need"))
        reached = [*reached, prefix]
    last, prefixes = reached[-1], reached[len(group):]
    cut = at.select(*group, F.col(last).alias("_cut"), "_need")
    x = _same(df, F.broadcast(cut), group)
    before = x.where(F.col(last) < F.col("_cut"))
    order = Window.partitionBy(*group, last).orderBy(key, tie)
    edge = (x.where(F.col(last) == F.col("_cut")).withColumn("_i", F.row_number().over(order))
            .where(F.col("_i") <= F.col("_need")).drop("_i"))
    return before.unionByName(edge).drop("_need", "_cut", *prefixes)


def ranks(df: DataFrame, group_cols: Sequence[str], key: str, tie: str, rank: str = "rank",
          widths: Sequence[int] = WIDTHS) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group by (``key``,
    ``tie``); ``key``: hexadecimal digits of a hash, never null."""
    group = list(group_cols)
    names = [f"_p{i}" for i in range(len(widths))]
    for i, name in enumerate(names):
        df = df.withColumn(name, F.substring(key, 1, sum(widths[:i + 1])))
    counts = df.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n"))
    starts = None
    for i in range(len(names)):
        level = counts.groupBy(*group, *names[:i + 1]).agg(F.sum("_n").alias("_n"))
        level = level.select(*group, *names[:i + 1], _before([*group, *names[:i]], names[i]).alias(f"_b{i}"))
        starts = level if starts is None else _same(level, starts, [*group, *names[:i]])
    starts = starts.select(*group, names[-1], sum(F.col(f"_b{i}") for i in range(len(names))).alias("_start"))
    within = Window.partitionBy(*group, names[-1]).orderBy(key, tie)
    x = df.withColumn("_i", F.row_number().over(within))
    out = _same(x, starts, [*group, names[-1]])
    return out.withColumn(rank, (F.col("_start") + F.col("_i")).cast("long")).drop("_start", "_i", *names)


def quota_takes(counts: DataFrame, quotas: DataFrame, sources: Sequence[str]) -> DataFrame:
    """How many rows each (class, source) gives in each pass, from counts alone.

    ``counts``: (class, source, n) of valid rows; ``quotas``: (class, quota).
    Pass 1 gives a source at most ceil(quota / number of sources) of a class,
    pass 2 what is still short, source by source in the listed order.  One row
    per (class, source, pass): size (rows there are), before (rows of the class
    in earlier cells), take.  Classes or sources that are not listed give none.
    """
    spark = counts.sparkSession
    src = spark.createDataFrame([(s, i) for i, s in enumerate(sources)], "source string, source_idx int")
    fair = F.greatest(F.lit(1), F.ceil(F.col("quota") / len(sources)))
    c = (counts.join(F.broadcast(src), "source").join(F.broadcast(quotas), "class")
         .withColumn("fair", fair.cast("long"))
         .withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2)))))
    own, shared = F.least("n", "fair"), F.least("n", "quota")
    c = c.withColumn("size", F.when(F.col("pass") == 1, F.least(own, shared)).otherwise(F.greatest(shared - own, F.lit(0))))
    order = Window.partitionBy("class").orderBy("pass", "source_idx").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))  # two rows a source
    take = F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("before")))
    return c.select("class", "source", "pass", "quota", "fair", "size", "before", take.cast("long").alias("take"))


def value_picks(values: DataFrame, col: str, ps: Sequence[float], low_bits: int = 11) -> DataFrame:
    """One row: n, the max(1, floor(n * p))-th smallest value for each p
    (columns p50, p90, ...), and max (AGG-10).  ``col`` holds whole numbers of
    32 bits; nulls do not count; no row at all gives no row.

    Rows are counted by value, and the places where values start come from the
    counts: running sums over the leading bits, then over the values that share
    them (at most ``2 ** low_bits``).  No row is ranked."""
    v = F.col(col).cast("long")
    counts = values.where(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_high", F.shiftright("_v", low_bits))
    high = counts.groupBy("_high").agg(F.sum("_n").alias("_n"))
    total = high.agg(F.sum("_n").alias("n"))  # one row
    high = high.select("_high", _before([], "_high").alias("_start"))  # a row for every 2 ** low_bits values
    low = counts.withColumn("_before", _before(["_high"], "_v"))
    spans = low.join(high, "_high").select("_v", (F.col("_start") + F.col("_before")).alias("_first"), "_n")
    x = spans.crossJoin(F.broadcast(total))  # one row
    aggs = []
    for p in ps:
        want = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(p)))
        hit = (F.col("_first") < want) & (want <= F.col("_first") + F.col("_n"))
        aggs.append(F.max(F.when(hit, F.col("_v"))).cast("int").alias(f"p{int(round(p * 100))}"))
    return x.groupBy("n").agg(*aggs, F.max("_v").cast("int").alias("max"))
