"""Readers and writers (SRC-1..4, SRC-7, SNK-1..4).

Scratch output goes to a fresh folder under the cluster's shared checkpoint
folder (``spark.checkpoint.dir``), never to a machine-local temp folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import checkpoint_dir

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
EXAMPLE_SCHEMA = T.StructType([
    T.StructField("example_id", T.LongType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("sql_context", T.StringType()),
    T.StructField("sql_prompt", T.StringType()),
    T.StructField("gold_sql", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("complexity", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("id", T.StringType()),
])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "quarry-out", f"{name}-{uuid.uuid4().hex[:12]}")


PART_ROWS = 500_000  # of a packed part file, which one task reads


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> int:
    """Write JSON Lines (one part file per task) and return the row count,
    measured while writing by an ``Observation`` -- no second pass (SNK-1).
    ``compression`` (``gzip``) packs the files, which readers tell by their name;
    such a file is not split when it is read, so long ones end at ``PART_ROWS``.
    Tables that are rewritten or kept: ``versions.VersionedTable`` (SNK-3, SNK-4)."""
    obs = Observation("rows")
    w = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(mode)
    if compression:
        w = w.option("compression", compression).option("maxRecordsPerFile", PART_ROWS)
    w.json(path)
    return int(obs.get.get("n", 0)) if obs.get else 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, first_n: int | None = None) -> DataFrame:
    """Read JSON Lines with an explicit schema; blank lines are skipped.
    ``first_n`` keeps the first rows in the order of the files' names and of
    the lines within a file (SRC-2)."""
    if first_n is None:
        return spark.read.schema(schema).json(path)
    value = first_lines(spark, path, first_n)
    return value.select(F.from_json("value", schema).alias("r")).select("r.*")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` lines of a folder's files that are not blank (value).

    Lines are counted by block, the stretch of a file that one task reads;
    blocks before the cut are taken whole, and only the lines of the block with
    the cut are numbered.  No line is sorted against those of other blocks."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"))
    blocks = lines.groupBy("file", "at").agg(F.count(F.lit(1)).alias("held"))
    order = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0))).where(F.col("before") < n)
    x = lines.join(blocks, ["file", "at"])
    whole = x.where(F.col("before") + F.col("held") <= n)
    cut = x.where(F.col("before") + F.col("held") > n)  # one block at most
    cut = cut.withColumn("i", F.row_number().over(Window.partitionBy("file", "at").orderBy("place")))
    return whole.select("value").unionByName(cut.where(F.col("before") + F.col("i") <= n).select("value"))


def read_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Several JSONL splits as one frame with a ``split`` column (SRC-3)."""
    out = None
    for split, p in paths.items():
        d = read_jsonl(spark, p, schema).withColumn("split", F.lit(split))
        out = d if out is None else out.unionByName(d)
    return out


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet partitioned by a split column: a later read of one split only
    lists and scans that split's folder (partition pruning)."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, by: str = "split") -> DataFrame:
    """Load one named split of a dataset (SRC-1)."""
    return spark.read.parquet(path).where(F.col(by) == split)


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Report JSON files (one document per file): (accepted, rejected) --
    a report without metrics is rejected, not an error for the batch (SRC-4)."""
    df = (spark.read.option("multiLine", True).json(path)
          .withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)))
    has = F.col("metrics").isNotNull() if "metrics" in df.columns else F.lit(False)
    return df.where(has), df.where(~has)


def row_hash_int(cols) -> Column:
    """A 60-bit integer from sha256 of the row's cells, each with its length
    before it; a NULL cell is a mark of its own."""
    text = [F.col(c).cast("string") for c in cols]
    h = F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, cols, name: str = "fp") -> DataFrame:
    """Order-insensitive fingerprint of a frame: row count and the exact sum
    of per-row 60-bit hashes (a multiset hash: partial aggregation, no global
    sort, nothing collected in one place) (SRC-7)."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(row_hash_int(cols)).cast("decimal(38,0)").cast("string").alias(name))
