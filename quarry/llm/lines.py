"""Line dedup: repeated runs of lines, found by distributed prefix doubling.

Every non-blank line of every document is a suffix of its document's sequence
of line identities.  Level 0 names a suffix by its first line; level k+1 names
it by its level-k name and that of the suffix 2**k lines on, so a name stands
for the first 2**(k+1) lines.  Suffixes with one name are an interval of the
suffix array whose longest common prefix is at least that long; a suffix alone
under its name leaves the game, so each level works on what still repeats.  A
suffix with an earlier copy (by doc_id, then line) has all lines of that prefix
deleted, once the prefix has ``min_run`` lines or more.  With ``long_words`` a
single line of more words than that counts as a run too.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import pick, prepare, stage

MIN_RUN = 2
LONG_WORDS = 50  # of the pipeline stage: a line of more words counts as a run


def _tag(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(t, F.length(t), F.crc32(F.encode(t, "utf-8")))


def _split(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, tag, all_pos, line."""
    d = pick(docs, doc_id="long", text="string").where("doc_id is not null").withColumn("tag", _tag(F.col("text")))
    return d.select("doc_id", "tag", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("all_pos", "line"))


def repeated_runs(docs: DataFrame, min_run: int = MIN_RUN, max_level: int = 30,
                  long_words: int | None = None) -> DataFrame:
    """Deleted stretches: doc_id, tag (of the row's text), pos (number of the non-blank line in its
    document, from 0), level, n_lines = 2**level; the stretch also starts
    earlier, in a smaller doc_id or further up in the same document.

    ``min_run``: a power of two.  ``long_words``: a single line counts too if
    it has more words (between white space); None: none does.  Lines are equal when their UTF-8 bytes are;
    blank lines (nothing but white space) are no part of the sequences.  Null
    and empty texts have no lines; rows without doc_id take no part.  Rows of
    one doc_id with different texts are sequences of their own, in the order of
    their tags; rows that repeat doc_id and text are one document.  Identity of
    lines is a 96-bit hash with the length.
    """
    if min_run < 1 or min_run & (min_run - 1):
        raise ValueError("min_run must be a power of two")
    lines = _split(docs).where(F.col("line").rlike(r"[^\x09-\x0D\x20]"))
    by_doc = Window.partitionBy("doc_id", "tag").orderBy("all_pos")
    # the identity is taken before rows move: texts are not shuffled
    ids = lines.select("doc_id", "tag", "all_pos", F.xxhash64("line").alias("a"),
                       F.xxhash64(F.crc32(F.encode("line", "utf-8")), F.length("line")).alias("b"), *_long(long_words))
    rows = ids.select("doc_id", "tag", (F.dense_rank().over(by_doc) - 1).alias("pos"), *ids.columns[3:],
                      F.lag("all_pos").over(by_doc).alias("_last"), "all_pos")
    # a line that repeats is that of a repeated row
    named = rows.where(F.col("_last").isNull() | (F.col("_last") != F.col("all_pos"))).drop("_last", "all_pos")
    active = _shared(named)
    level, found = 0, []
    while True:
        active = stage(active, f"lines-level{level}")
        if 1 << level >= min_run or "long" in active.columns:
            found.append(active.where("not first" if 1 << level >= min_run else "not first and long").select(
                "doc_id", "tag", "pos", F.lit(level).alias("level"), F.lit(1 << level).cast("long").alias("n_lines")))
        if 1 << level >= min_run and (level >= max_level or active.isEmpty()):
            break
        gap = 1 << level
        ahead = Window.partitionBy("doc_id", "tag").orderBy("pos").rangeBetween(gap, gap)
        pairs = (active.withColumn("a2", F.first("a").over(ahead)).withColumn("b2", F.first("b").over(ahead))
                 .where("a2 is not null")
                 .select("doc_id", "tag", "pos", F.xxhash64("a", "a2", "b2").alias("a"),
                         F.xxhash64("b", "b2", "a2", "a").alias("b")))
        active = _shared(pairs)
        level += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _long(words: int | None) -> list[Column]:
    """Whether ``line`` has more words; counted only where it has room for them."""
    if words is None:
        return []
    count = F.regexp_count("line", F.lit(r"[^\x09-\x0D\x20]+"))
    return [F.when(F.length("line") > 2 * words, count > words).otherwise(False).alias("long")]


def _shared(named: DataFrame) -> DataFrame:
    """Rows whose name is not theirs alone, with ``first``: no earlier row has it."""
    groups = (named.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "pos")).alias("at"))
              .where("n > 1").select("a", "b", "at"))
    return (named.join(groups, ["a", "b"])
            .select("doc_id", "tag", "pos", "a", "b", *named.columns[5:], (F.struct("doc_id", "tag", "pos") == F.col("at")).alias("first")))


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, long_words: int | None = None) -> DataFrame:
    """``docs`` with four more columns: n_lines (non-blank), n_removed,
    longest_run (the longest prefix, a power of two, that a deleted stretch
    shares with an earlier one; 1 if only single long lines do, 0 if none) and kept_text (lines left, blank
    ones included, joined by a line feed).  Those names are replaced if ``docs``
    has them; other extra columns pass through.  Null and empty texts: no
    lines, kept_text empty; a document may end up empty.  A row without doc_id
    loses nothing and nothing is lost to it.  Rows of one doc_id are judged by
    their own texts, those that repeat a text alike.
    """
    gone = (repeated_runs(docs, min_run, long_words=long_words).groupBy("doc_id", "tag").agg(
        F.collect_list("pos").alias("at"), F.collect_list("n_lines").alias("size"))
        .select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), F.struct("at", "size").alias("_runs")))
    prepare(docs.sparkSession)
    d = docs.drop("n_lines", "n_removed", "longest_run", "kept_text")
    both = d.join(gone, (d["doc_id"].cast("long") == F.col("_doc")) & (_tag(d["text"]) == F.col("_tag")), "left")
    cut = F.pandas_udf(_cut, "n_lines long, n_removed long, longest_run long, kept_text string")
    done = both.withColumn("_cut", cut(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("_runs.at"), F.col("_runs.size")))
    return done.select(*[F.col(f"`{c}`") for c in d.columns], "_cut.n_lines", "_cut.n_removed", "_cut.longest_run", "_cut.kept_text")


def _cut(texts: pd.Series, ats: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    blank = " \t\n\r\x0b\x0c"
    out = []
    for text, at, size in zip(texts, ats, sizes):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(blank)]
        if at is None:
            out.append((len(full), 0, 0, text))
            continue
        longest = {}
        for p, n in zip(at, size):
            longest[p] = max(longest.get(p, 0), n)
        till, cut = 0, set()
        for i, line in enumerate(full):
            till = max(till, i + longest.get(i, 0))
            if i < till:
                cut.add(line)
        out.append((len(full), len(cut), int(max(size)), "\n".join(x for i, x in enumerate(lines) if i not in cut)))
    return pd.DataFrame(out, columns=["n_lines", "n_removed", "longest_run", "kept_text"])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "longest_run",
                                    F.sha2("kept_text", 256).alias("kept_sha256"))


def stage_line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without later copies of line runs, single lines of
    more than ``LONG_WORDS`` words among them; a document of
    which nothing but white space is left goes, if lines were deleted."""
    cleaned = dedup_lines(docs, long_words=LONG_WORDS).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x09-\x0D\x20]"))
    same = F.col("n_removed") == 0
    return cleaned.select("doc_id", F.when(same, F.col("text")).otherwise(F.col("kept_text")).alias("text"), "lang", "source",
                          F.when(same, F.col("n_chars")).otherwise(F.length("kept_text")).cast("long").alias("n_chars"))
