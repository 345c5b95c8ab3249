"""Result-set comparison for many examples at once (CMP-1, CMP-2, JN-13).

Input is a long table of result rows ``(example_id, side, pos, cells...)``
with ``side`` in {gold, pred}.  Cells are turned into one canonical key per
row (typed: numbers to 4 decimals, strings stripped, NULL marked),
so the comparison is plain relational algebra:

* bag (multiset) equality: +1 for gold, -1 for pred, sum per
  (example, key); the example matches when every sum is zero.  Two
  aggregations, both with map-side partial aggregation, so an example with a
  huge result set is spread over many tasks in the first and collapses to one
  partial row per task in the second.
* ordered equality: full outer join of gold and pred on (example, pos) with
  null-safe key equality; a missing or extra row makes the example fail.

Examples with no rows on either side match (two empty results are equal);
the caller passes the frame of all example ids for that.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import strip


def _number_key(x: Column) -> Column:
    """One text for equal numbers, whatever their type: whole ones (-0.0 is 0)
    as integers, others as doubles; NaN and the infinities keep their names."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(2.0 ** 63))
    return F.when(whole, F.when(whole, x).cast("long").cast("string")).otherwise(x.cast("string"))


def cell_key(col: Column, dtype: T.DataType) -> Column:
    """Kind and value of a cell: numbers (to 4 decimals; true is 1) never equal
    texts (stripped), and NULL equals NULL only.  The length before the value
    keeps neighbouring cells apart whatever they hold."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        kind, v = "n", _number_key(F.round(col.cast("double"), 4))
    elif isinstance(dtype, T.BooleanType):
        kind, v = "n", col.cast("int").cast("string")
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        kind, v = "n", col.cast("string")
    elif isinstance(dtype, T.StringType):
        kind, v = "t", strip(col)
    elif isinstance(dtype, T.BinaryType):
        kind, v = "b", F.hex(col)
    else:
        kind, v = "t", col.cast("string")
    return F.coalesce(F.concat(F.lit(kind), F.length(v).cast("string"), F.lit(":"), v), F.lit("z"))


def row_key(df: DataFrame, cells: Sequence[str]) -> Column:
    """One canonical text key per result row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat(*[cell_key(F.col(c), types[c]) for c in cells])


def keyed(df: DataFrame, cells: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select("example_id", "side", *keep, row_key(df, cells).alias("row_key"))


def dense_positions(df: DataFrame, order_cols: Sequence[str], pos: str = "pos") -> DataFrame:
    """Turn a sparse per-(example, side) order into 0-based positions.

    Ties in the order are broken by the following columns (pass the row key
    last so that equal positions resolve the same way in every engine).
    ``rank_in_groups``: group-relative global positions, so a huge result set
    is not sorted in one task.  Executors that emit rows with their fetch index
    already give dense positions; this is only for inputs that do not.
    """
    from quarry.operators.sample import rank_in_groups
    return rank_in_groups(df, ["example_id", "side"], list(order_cols), pos)


def match_bag(keys: DataFrame, example_ids: DataFrame) -> DataFrame:
    """(example_id, match) by multiset equality of row keys."""
    w = F.when(F.col("side") == "gold", F.lit(1)).otherwise(F.lit(-1))
    per_key = keys.groupBy("example_id", "row_key").agg(F.sum(w).alias("d"))
    per_ex = per_key.groupBy("example_id").agg(
        (F.max(F.abs("d")) == 0).alias("match"))
    return (example_ids.join(per_ex, "example_id", "left")
            .select("example_id", F.coalesce("match", F.lit(True)).alias("match")))


def match_ordered(keys: DataFrame, example_ids: DataFrame) -> DataFrame:
    """(example_id, match) by position-wise equality of row keys."""
    g = keys.where(F.col("side") == "gold").select(
        "example_id", "pos", F.col("row_key").alias("g"))
    p = keys.where(F.col("side") == "pred").select(
        "example_id", "pos", F.col("row_key").alias("p"))
    per_ex = (g.join(p, ["example_id", "pos"], "full_outer")
              .groupBy("example_id")
              .agg(F.bool_and(F.col("g").eqNullSafe(F.col("p"))).alias("match")))
    return (example_ids.join(per_ex, "example_id", "left")
            .select("example_id", F.coalesce("match", F.lit(True)).alias("match")))


def match_results(keys: DataFrame, example_ids: DataFrame, ordered_col: str = "ordered") -> DataFrame:
    """Per example: ordered comparison when the gold asked for an order, else
    bag.  ``example_ids`` carries the boolean ``ordered`` column; each example's
    rows go through exactly one of the two comparisons."""
    ids = example_ids.select("example_id", F.coalesce(F.col(ordered_col), F.lit(False)).alias("__o"))
    k = keys.join(ids, "example_id")
    bag = match_bag(k.where(~F.col("__o")).drop("__o"), ids.where(~F.col("__o")).select("example_id"))
    seq = match_ordered(k.where(F.col("__o")).drop("__o"), ids.where(F.col("__o")).select("example_id"))
    return bag.unionByName(seq)


def frames_equal_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag equality of two whole frames (same column count): one-row verdict.

    ``exceptAll`` both ways keeps duplicates, so counts matter.
    """
    ka = a.select(row_key(a, a.columns).alias("k"))
    kb = b.select(row_key(b, b.columns).alias("k"))
    diff = ka.exceptAll(kb).union(kb.exceptAll(ka))
    return diff.agg((F.count(F.lit(1)) == 0).alias("match"))
