"""Substring dedup: repeated windows of words behind a count-min prefilter.

A window's representative is the smallest hash among its word 8-grams, so equal
windows have equal representatives and a document has few of them.  A sketch of
the representatives, merged from all tasks, overestimates in how many documents
a window can start; only windows that may start in two or more are grouped
exactly, by a 96-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import mix, pick, prepare, slide_min, span_hashes
from quarry.llm.sketch import SCHEMA, Sketch
from quarry.llm.wordtext import WordArrays, slices

SIZE, GRAM = 50, 8


def _represented(w: WordArrays, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, whether each opens a run of windows with one
    representative, and the representatives."""
    at = w.windows(size)
    if not len(at):
        return at, np.zeros(0, bool), np.zeros(0, np.uint64)
    i = np.arange(len(w.hash) - gram + 1)
    least = slide_min(span_hashes(w.hash, i, i + gram), size - gram + 1)[at]
    doc = w.doc[at]
    return at, np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])], least


def repeated_windows(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, hashes: the windows of a document that also start in a document
    with a smaller doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    gram = min(gram, size)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has some six bytes, and a representative holds for half as many windows as it has grams to choose from
    sketch = Sketch(total / 6 * 2 / (size - gram + 2), depth=2, max_log2=27)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = []
            for ids, texts in slices(b["doc_id"], b["text"]):
                w = WordArrays(texts)
                at, opens, least = _represented(w, size, gram)
                doc = np.array(ids, np.int64)[w.doc[at[opens]]]
                _, once = np.unique(mix(least[opens] ^ mix(doc.view(np.uint64))), return_index=True)
                keys.append(least[opens][once])
            yield sketch.partial(np.concatenate(keys))

    bits = spark.sparkContext.broadcast(sketch.merge(docs.mapInPandas(count, SCHEMA))[0])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each window of some documents: the smallest of them, and the rest."""
        for b in batches:
            for ids, texts in slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = WordArrays(texts)
                at, opens, least = _represented(w, size, gram)
                if not len(at):
                    continue
                at = at[sketch.reaches(bits.value, least[opens])[np.cumsum(opens) - 1]]
                h1 = span_hashes(w.hash, at, at + size)
                h2 = (span_hashes(w.hash, at, at + size, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                doc = np.array(ids, np.int64)[w.doc[at]]
                o = np.lexsort((doc, h2, h1))
                h1, h2, doc = h1[o], h2[o], doc[o]
                new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(o) else np.zeros(0, bool)
                other = ~new & np.r_[True, doc[1:] != doc[:-1]] if len(o) else new
                n = np.concatenate([np.cumsum(other)[np.r_[np.flatnonzero(new)[1:] - 1, len(o) - 1]]]) if len(o) else np.zeros(0, np.int64)
                more = pa.ListArray.from_arrays(pa.array(np.r_[0, n].astype(np.int32)), pa.array(doc[other]))
                yield pa.RecordBatch.from_arrays([pa.array(h1[new].view(np.int64)), pa.array(h2[new]), pa.array(doc[new]), more],
                                                 names=["h1", "h2", "doc", "more"])

    rows = docs.mapInArrow(emit, "h1 long, h2 int, doc long, more array<long>")
    # a row for each window and slice of documents: also a window of half the corpus has few
    owned = rows.withColumn("owner", F.min("doc").over(Window.partitionBy("h1", "h2")))
    late = F.concat(F.when(F.col("doc") > F.col("owner"), F.array("doc")).otherwise(F.array().cast("array<long>")), F.col("more"))
    return owned.select(F.explode(late).alias("doc_id"), "h1").groupBy("doc_id").agg(F.collect_list("h1").alias("hashes"))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words left, joined by one space).

    Words lie between \\x20 and \\x09-\\x0D.  A word goes when a window of
    ``size`` words over it also starts in a document with a smaller doc_id, as
    the input has them.  Null and empty texts have no words; a row without
    doc_id loses nothing and takes nothing; rows with one doc_id are one
    document to others and keep what they share.  Other columns are ignored.
    """
    d = pick(docs, doc_id="long", text="string")
    late = repeated_windows(d.where("doc_id is not null and text is not null"), size, gram)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, removed, kept = [], [], []
            for hashes, t in zip(b["hashes"], b["text"]):
                if hashes is None:
                    ws = [] if t is None else t.encode("utf-8", "replace").split()
                    gone = 0
                else:
                    w = WordArrays([t.encode("utf-8", "replace")])
                    ws, at = w.words[0], w.windows(size)
                    hit = at[np.isin(span_hashes(w.hash, at, at + size), np.array(hashes, np.int64).view(np.uint64))]
                    marks = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(marks, hit, 1)
                    np.add.at(marks, hit + size, -1)
                    stay = np.cumsum(marks[:-1]) == 0
                    gone = len(ws) - int(stay.sum())
                    words.append(len(ws))
                    ws = [x for x, s in zip(ws, stay) if s]
                    removed.append(gone)
                    kept.append(b" ".join(ws).decode())
                    continue
                words.append(len(ws))
                removed.append(0)
                kept.append(b" ".join(ws).decode())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": words, "n_removed": removed, "kept_text": kept})

    return (d.join(late, "doc_id", "left").select("doc_id", "text", "hashes")
            .mapInPandas(apply, "doc_id long, n_words long, n_removed long, kept_text string"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
