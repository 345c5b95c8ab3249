"""Exact dedup by an extendible-hash index, with DataFrame functions only.

The index lies on shared files.  A text's key is a digest of it; leading bits
of the key are a pointer of the directory, and a pointer leads to a bucket.  A
bucket over its capacity is split by one more bit, and so on: doubling the
directory as often as the fullest bucket needs.  Texts meet as (key, text), so
that copies are combined before they are shuffled and equality is settled on
bytes; the entries left, one for each different text, go to tasks that own
ranges of keys, which chain those of one key.  Documents look their key up.
Keys with a longer chain than one text are told apart by the text itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import lower_ascii, pick, stage

BUCKET_ROWS = 4096  # different texts a bucket holds before it is split
BITS = 16  # of the directory at most: 65,536 pointers, small enough for every task
HOT_SHARE = 1000  # a text with more than one in so many rows is hot; so there are fewer than that


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null gives the empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # where every character is one byte the built-in does the same, and faster
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(lower_ascii(t))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _pointer(bits: int) -> Column:
    """The first ``bits`` bits of the key, a string of hexadecimal digits."""
    return F.shiftright(F.conv(F.rpad(F.substring("key", 1, 4), 4, "0"), 16, 10).cast("int"), 16 - bits)


def directory(keys: DataFrame, bits: int, capacity: int) -> DataFrame:
    """pointer (``bits`` long, those in use), depth and bucket (its first
    pointer) for the distinct ``keys``.  Each bucket holds at most ``capacity``
    keys, unless it is as deep as the directory may be."""
    used = keys.groupBy(_pointer(bits).alias("pointer")).agg(F.count("*").alias("n"))
    above = used.select("pointer", "n", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level"))
    above = above.withColumn("prefix", F.expr(f"shiftright(pointer, {bits} - level)"))
    split = above.groupBy("level", "prefix").agg(F.sum("n").alias("held")).where(F.col("held") > capacity)
    deep = above.join(split.drop("held"), ["level", "prefix"]).groupBy("pointer").agg((F.max("level") + 1).alias("depth"))
    out = used.join(deep, "pointer", "left").select("pointer", F.coalesce("depth", F.lit(0)).alias("depth"))
    return out.withColumn("bucket", F.expr(f"shiftleft(shiftright(pointer, {bits} - depth), {bits} - depth)"))


def _largest() -> Column:
    """The row that stays: the largest doc_id, null below all; of rows that repeat it, one."""
    return F.max(F.struct("doc_id", "row"))


def exact_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id (the largest doc_id
    among equal texts), group_size, kept, key (``digest`` of the normalised
    text, hexadecimal), bucket and chain (different texts of that key).

    Texts are equal when their bytes are, once A-Z is lower-case; whatever
    ``digest`` is, unequal texts stay apart.  Null counts as empty.  Exactly one row of
    a group is kept: of rows that repeat the largest doc_id any one, a row
    without doc_id only if no other has one (keep_id is then null).  Other
    columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = pick(docs, doc_id="long", text="string").select("doc_id", normalised(F.col("text")).alias("norm"))
    texts = texts.withColumn("key", digest(F.col("norm")))
    entries = stage(texts.select("doc_id", "key", F.monotonically_increasing_id().alias("row")), "entries")
    groups = stage(entries.groupBy("key").agg(F.count("*").alias("n"), _largest().alias("top")), "keys")

    rows, keys = entries.count(), groups.count()
    capacity = max(bucket_rows, math.ceil(8 * keys / (1 << BITS)))
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, keys) / capacity))) + 3)
    pointers = F.broadcast(directory(groups, bits, capacity))  # at most 2**BITS rows of three numbers

    # one row for each different text, made of bytes compared; the text itself is not kept
    different = texts.groupBy("key", "norm").agg(F.count("*").alias("copies")).select("key", _pointer(bits).alias("pointer"))
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = F.expr(f"cast(shiftright(cast(pointer as bigint) * {owners}, {bits}) as int)")
    pages = stage(different.repartitionById(owners, owner).sortWithinPartitions("key"), "buckets")
    chains = pages.groupBy("key", "pointer").agg(F.count("*").alias("chain"))
    index = stage(groups.join(chains, "key").join(pointers, "pointer").select("key", "bucket", "chain", "n", "top"), "index")

    alone, hot = index.where("chain = 1"), F.col("n") * HOT_SHARE > rows
    common, rest = F.broadcast(alone.where(hot)), alone.where(~hot)
    found = entries.join(common, "key").unionByName(entries.join(rest, "key"))
    chained = index.where("chain > 1").select("key", "bucket", "chain")
    if not chained.isEmpty():
        again = stage(texts.join(chained, "key").withColumn("row", F.monotonically_increasing_id()), "chained")
        told = stage(again.groupBy("key", "norm").agg(F.count("*").alias("n"), _largest().alias("top")), "told")
        found = found.unionByName(again.join(told, ["key", "norm"]).drop("norm"))
    return found.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("row") == F.col("top.row")).alias("kept"), "key", "bucket", "chain")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: the row that stays for its text, and whether it is that."""
    return exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("key").alias("text_sha256"))
