"""Multi-level aggregation: aggregate rows into (group, sub) cells, then compute
something across the cells of each group -- share of the group total, rank,
top-N, top-1, above the group's own average.

Plan shape.  The per-group quantities that are plain aggregates (total, mean,
max) are computed with a second ``groupBy`` on the already-aggregated frame
and joined back on the group key, not with ``SUM(..) OVER (PARTITION BY g)``:
a window puts a whole group into one task, the join lets partial aggregation
and AQE's skew-join split a hot group.  Rank needs an order inside the group,
so it stays a window; for top-N Catalyst inserts a ``WindowGroupLimit`` that
cuts every group to N candidates per map task before the shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def group_measure(df: DataFrame, keys: Sequence[str] | str, measure: Column,
                  total: str = "total", distinct_of: str | None = None,
                  uniques: str = "uniques") -> DataFrame:
    """SUM(measure) and optionally COUNT(DISTINCT distinct_of) per key (AGG-14)."""
    aggs = [F.sum(measure).alias(total)]
    if distinct_of is not None:
        aggs.append(F.countDistinct(distinct_of).alias(uniques))
    return df.groupBy(*_keys(keys)).agg(*aggs)


def _group_stat(agg: DataFrame, group, total: str, fn, name: str) -> DataFrame:
    g = _keys(group)
    stat = agg.groupBy(*g).agg(fn(F.col(total)).alias(name))
    return agg.join(stat, on=g, how="inner")


def with_share(agg: DataFrame, group, total: str, pct: str = "pct",
               scale: int | None = 4) -> DataFrame:
    """Share of the group total in percent (WIN-1).

    The ratio is taken in DOUBLE from exact (DECIMAL or integer) totals so the
    result does not depend on summation order.
    """
    out = _group_stat(agg, group, total, F.sum, "__group_total")
    ratio = (F.col(total).cast("double") * F.lit(100.0)
             / F.col("__group_total").cast("double"))
    if scale is not None:
        ratio = F.round(ratio, scale)
    return out.withColumn(pct, ratio).drop("__group_total")


def with_rank(agg: DataFrame, group, total: str, rnk: str = "rnk",
              tie_keys: Sequence[str] = ()) -> DataFrame:
    """RANK() within the group by total descending; ties share a rank (WIN-2)."""
    w = Window.partitionBy(*_keys(group)).orderBy(F.col(total).desc())
    return agg.withColumn(rnk, F.rank().over(w).cast("bigint"))


def top_n(agg: DataFrame, group, total: str, n: int, rnk: str = "rnk",
          pct: str | None = "pct") -> DataFrame:
    """Top-N cells per group with share and rank (WIN-3); ties at N are kept."""
    base = with_share(agg, group, total, pct) if pct is not None else agg
    # filter right after the window so Catalyst can plan a WindowGroupLimit
    return with_rank(base, group, total, rnk).where(F.col(rnk) <= F.lit(n))


def top1_rank(agg: DataFrame, group, total: str) -> DataFrame:
    """Cells ranked first in their group (WIN-4), ties kept."""
    return with_rank(agg, group, total, "__r").where(F.col("__r") == 1).drop("__r")


def top1_max(agg: DataFrame, group, total: str) -> DataFrame:
    """``total = (SELECT MAX(total) FROM agg u WHERE u.g = t.g)`` (JN-9).

    Catalyst decorrelates the SQL form into exactly this: a join to the
    per-group maximum.
    """
    return (_group_stat(agg, group, total, F.max, "__m")
            .where(F.col(total) == F.col("__m")).drop("__m"))


def above_group_avg(agg: DataFrame, group, total: str) -> DataFrame:
    """Cells whose total exceeds the mean total of their group (WIN-5, JN-10).

    The window form ``AVG(t) OVER (PARTITION BY g)`` and the correlated
    subquery form give the same rows; both are planned as a join to the
    per-group mean.
    """
    return (_group_stat(agg, group, total, F.avg, "__a")
            .where(F.col(total) > F.col("__a")).drop("__a"))


def above_group_avg_window(agg: DataFrame, group, total: str) -> DataFrame:
    """The literal window formulation of WIN-5 (kept for plan comparison)."""
    w = Window.partitionBy(*_keys(group))
    return (agg.withColumn("__a", F.avg(F.col(total)).over(w))
            .where(F.col(total) > F.col("__a")).drop("__a"))
