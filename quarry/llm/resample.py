"""Importance resampling towards a target: hashed n-grams, a sorted draw.

Tasks count n-gram buckets of the corpus and of the target as arrays of one
length; the log ratio of the two gives each bucket's gain, and an array lookup
scores whole batches of texts.  The noisy scores are sorted by regular
sampling: every task sorts a run, rows at regular places of all runs give the
splitters, the segments between two splitters are exchanged and merged, and
the sizes of the segments before it give each row its exact rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import pick, prepare, stage
from quarry.llm.wordtext import slices

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
MOST_SEGMENTS = 1024  # of the sort; its samples are at most about the square of it
_SHORT = 48  # bytes of words that are hashed all at once


def _crc_step(x: np.ndarray) -> np.ndarray:
    """A CRC-32 register after eight zero bits."""
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (x & np.uint32(1)))
    return x


_BYTE = _crc_step(np.arange(256, dtype=np.uint32))


def _zero_bytes(count: int) -> np.ndarray:
    """[k, i, b]: the register holding b in its byte i, after k zero bytes."""
    x = (np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    out = [x]
    for _ in range(count):
        x = (x >> np.uint32(8)) ^ _BYTE[x & np.uint32(255)]
        out.append(x)
    return np.ascontiguousarray(out).reshape(-1)


_AFTER = _zero_bytes(_SHORT + 1)
_ZEROS = np.array([zlib.crc32(bytes(k)) for k in range(3 * _SHORT + 3)], np.uint32)
# bytes of words stay, capital letters become small, the rest is white space
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def _after(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Registers ``x`` after ``k`` zero bytes each."""
    at = k.astype(np.int32) << 10
    out = _AFTER[at + (x & np.uint32(255)).astype(np.int32)]
    for i in (1, 2, 3):
        out ^= _AFTER[at + (i << 8) + ((x >> np.uint32(8 * i)) & np.uint32(255)).astype(np.int32)]
    return out


class NGrams:
    """Crc32 of all runs of one to three words of each text, as arrays over the
    words: ``grams[k]`` belongs to the run of k + 1 words that starts there and
    counts where ``inside[k]``.  ``first``: index of each text's first word."""

    def __init__(self, texts: list[bytes]):
        blob = b" ".join(t.translate(_FOLD) for t in texts) + b" "
        a = np.frombuffer(blob, np.uint8)
        solid = np.concatenate([[False], a != 32]).astype(np.int8)
        edge = np.diff(solid)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(start, starts)
        n, size = len(start), end - start
        doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        one = self._registers(blob, a, start, size)
        k = np.minimum(size, _SHORT)
        spaced = one ^ _after(np.full(n, _BYTE[32]), k)  # a space, then the word
        long = size > _SHORT
        self.grams, self.inside = [one], [np.ones(n, bool)]
        length, split = size, long
        for more in (1, 2):
            m = max(0, n - more)
            whole = _after(self.grams[-1][:m], k[more:] + 1) ^ spaced[more:]
            length, split = length[:m] + 1 + size[more:], split[:m] | long[more:]
            for i in np.flatnonzero(split):
                run = b" ".join(blob[start[i + j]:end[i + j]] for j in range(more + 1))
                whole[i] = zlib.crc32(run) ^ zlib.crc32(bytes(len(run)))
            self.grams.append(whole)
            self.inside.append(doc[:m] == doc[more:])
        sizes = [size, size[:-1] + 1 + size[1:], size[:-2] + size[1:-1] + size[2:] + 2]
        for j, (g, s) in enumerate(zip(self.grams, sizes)):
            small = s < len(_ZEROS)
            ones = _ZEROS[np.where(small, s, 0)]
            for i in np.flatnonzero(~small):
                ones[i] = zlib.crc32(bytes(int(s[i])))
            self.grams[j] = g ^ ones

    @staticmethod
    def _registers(blob: bytes, a: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The register after each word from zero, a byte of all words at a time."""
        short = np.minimum(size, _SHORT + 1).astype(np.uint8)
        order = np.argsort(short, kind="stable")[::-1]
        at, left = start[order], size[order]
        x = np.zeros(len(start), np.uint32)
        longer = np.cumsum(np.bincount(short, minlength=_SHORT + 2)[::-1])[::-1]  # words of at least so many bytes
        for j in range(_SHORT):
            m = int(longer[j + 1])
            if not m:
                break
            x[:m] = (x[:m] >> np.uint32(8)) ^ _BYTE[(x[:m] ^ a[at[:m] + j]) & np.uint32(255)]
        for i in range(int(longer[_SHORT + 1])):
            word = blob[at[i]:at[i] + left[i]]
            x[i] = zlib.crc32(word) ^ zlib.crc32(bytes(len(word)))
        out = np.empty_like(x)
        out[order] = x
        return out

    def counts(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for g, ok in zip(self.grams, self.inside):
            out += np.bincount(g[ok] % np.uint32(buckets), minlength=buckets)
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its words, its runs of words, and the sum of their gains."""
        words = np.diff(self.first)
        total = np.zeros(int(self.first[-1]) + 1, np.int64)
        for g, ok in zip(self.grams, self.inside):
            total[1:len(g) + 1] += np.where(ok, gains[g % np.uint32(len(gains))], 0)
        np.cumsum(total, out=total)
        runs = words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0)
        return words, runs, total[self.first[1:]] - total[self.first[:-1]]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task adds up its own before Spark does."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, blobs in slices(b["text"], b["text"]):
                total += NGrams(blobs).counts(buckets)
        yield pd.DataFrame({"counts": [total]})

    parts = pick(texts, text="binary").mapInPandas(run, "counts array<long>")
    sums = parts.select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # one number a bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares of each bucket."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus, target)], np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every row of ``docs``:
    weight adds the gains of the text's features, score adds Gumbel noise that
    depends on ``seed`` and doc_id alone (a null doc_id counts as empty text)."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, blobs in slices(range(len(b)), b["text"]):
                words, runs, weight = NGrams(blobs).sums(gains)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[ids[0]:ids[-1] + 1].astype("Int64"), "n_words": words, "n_features": runs, "weight": weight})

    rows = pick(docs, doc_id="long", text="binary").mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(draw))).cast("long"))


def sorted_ranks(rows: DataFrame, segments: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 1) by falling score, ties to the smaller
    doc_id, null last, then in any order.  Parallel sorting by regular sampling
    with ``segments`` runs and segments (the shuffle partitions, at most
    ``MOST_SEGMENTS``): no segment has more than about twice its share, ties and
    repeated rows included, since a row's place in its run tells it apart."""
    spark = rows.sparkSession
    prepare(spark)
    parts = max(1, min(segments or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SEGMENTS))
    id_, order = F.coalesce("doc_id", F.lit((1 << 63) - 1)), [F.desc("score"), F.asc_nulls_last("doc_id")]
    runs = rows.coalesce(parts).sortWithinPartitions(*order).withColumn("_run", F.spark_partition_id())
    runs = stage(runs.withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "runs")
    n = runs.count()
    step = max(1, n // parts ** 2)
    key = ["score", id_.alias("_id"), "_run", "_at"]
    samples = runs.where(F.col("_at") % step == step // 2).select(*key).toPandas()  # at most parts**2 + 2 * parts rows of numbers
    by = lambda f: (f["_at"], f["_run"], f["_id"], -f["score"])
    samples = samples.iloc[np.lexsort(by(samples))]
    splitters = samples.iloc[np.arange(1, parts) * len(samples) // parts] if len(samples) >= parts else samples

    def cut(score: pd.Series, ids: pd.Series, run: pd.Series, at: pd.Series) -> pd.Series:
        """How many splitters come before each row."""
        both = pd.concat([splitters, pd.DataFrame({"score": score, "_id": ids, "_run": run, "_at": at})], ignore_index=True)
        ahead = np.lexsort(by(both))
        out = np.empty(len(both), np.int32)
        out[ahead] = np.cumsum(ahead < len(splitters))
        return pd.Series(out[len(splitters):])

    cut_at = F.pandas_udf(cut, "int")
    placed = stage(runs.withColumn("_segment", cut_at("score", id_, "_run", "_at")), "segments")
    sizes = {r[0]: r[1] for r in placed.groupBy("_segment").count().collect()}  # a number a segment
    before = np.cumsum([0] + [sizes.get(i, 0) for i in range(parts + 1)])
    start = F.element_at(F.array(*[F.lit(int(x)) for x in before]), F.col("_segment") + 1)
    within = Window.partitionBy("_segment").orderBy(*order, "_run", "_at")
    ranked = placed.withColumn("rank", F.row_number().over(within) + start)
    return ranked.withColumn("rank", F.col("rank").cast("long")).drop("_run", "_at", "_segment")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``; rank
    is null unless the row is drawn: one of the floor(percent * N / 100) highest
    scores among the N rows of at least ``least_words`` words.

    Words are runs of letters a-z, digits and characters beyond ASCII; null and
    empty texts have none and weigh 0.  Repeated rows are rows of their own.  A
    corpus or target without features has no counts, and all smoothed shares are
    alike there.  Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    scored = stage(importance_scores(docs, target, seed, buckets), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    n = fit.count() * percent // 100
    drawn = sorted_ranks(fit).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resample(spark, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards ``benchmark``, and the draw."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
