"""N-gram Jaccard join with set-relation skipping.

Sets are the distinct 5-word shingles of documents; two link when they share 75
% of their union.  Equal sets become one.  Shingles are counted shard by shard
(``shards.py``), and each batch of documents is told which of its own are surely
in one document only: a set with too many of those has no partner, the others
are indexed under a prefix of their rarest shingles, so that sets that link meet
in some index list.

Index level: an entry knows its shingle's position in its set's order, and what
follows bounds the overlap of two sets that first meet there.  A list is cut
into blocks of nearly equal set size, and blocks that cannot reach the threshold
are skipped whole; of two sets the smaller one must hold the shingle near its
front, so a list's later entries only meet its front ones.  Answer level: a
list's members are first compared with one leading set.  From the
leader's answers follow bounds for every pair of members
(``|x&l| + |y&l| - |l| <= |x&y| <= |x&l| + min(|x - l|, |y - l|)`` and the
like); only pairs they leave open, between sets that are not connected yet, are
counted.  Where lists hold many of those, a second round of leaders connects
what it can before.  The parity of a set's shingles in each of 512 cells bounds from below
how many shingles two sets do not share, and a pair it rules out is not made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import mix, pick, prepare, span_hashes, stage, tidy
from quarry.llm.shards import PLACES, Shards
from quarry.llm.sketch import SCHEMA, Sketch
from quarry.llm.wordtext import WordArrays

GRAM, PERCENT = 5, 75
BATCH = 1 << 20  # bytes of text worked on at once, about
COMMON = 32  # shingles in so many documents or more come last in the prefix order
LEADERS = 2  # rounds at most in which the lists' members are compared with a leader only
FEW = 32  # open pairs for each entry of the lists that need no other leaders
WORDS = 8  # of 64 cells, with the parities of a set

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_sets(texts: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, shingle), sorted, each once."""
    w = WordArrays([t.translate(_LOWER) for t in texts])
    size = np.diff(w.first)
    at = w.windows(gram)
    short = np.flatnonzero((size > 0) & (size < gram))
    start = np.concatenate([at, w.first[short]])
    end = np.concatenate([at + gram, w.first[short] + size[short]])
    doc = w.doc[start] if len(start) else start
    h = span_hashes(w.hash, start, end)
    o = np.lexsort((h, doc))
    doc, h = doc[o], h[o]
    once = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(o) else np.zeros(0, bool)
    return doc[once], h[once]


def _least(n: np.ndarray | int, percent: int):
    """Smallest overlap a set of ``n`` has with any partner."""
    return -(-n * percent // 100)


def _batches(docs: DataFrame, total: int) -> DataFrame:
    """``docs`` dealt over numbered batches of about ``BATCH`` bytes (and a longer
    text now and then), written, so that a batch holds the same rows whenever it is read."""
    n = max(1, -(-total // BATCH))
    return stage(docs.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))), "batches")


def _digests(docs: DataFrame, gram: int, percent: int) -> DataFrame:
    """doc_id, n, and for sets that can have a partner: two digests of the set,
    ``prefix`` and ``members``, its shingles that may be in other documents."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = Shards(total / 6)
    thresholds = (2, COMMON)
    batches = _batches(docs, total).groupBy("batch")

    def sets_of(f: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
        texts = [b"" if t is None else t.encode("utf-8", "replace") for t in f["text"]]
        return list(f["doc_id"]), *shingle_sets(texts, gram)

    def count(f: pd.DataFrame) -> pd.DataFrame:
        return shards.partial(int(f["batch"].iloc[0]), sets_of(f)[2])

    def emit(f: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, doc, h = sets_of(f)
        n = np.bincount(doc, minlength=len(ids)).astype(np.int64)
        shared, common = shards.flags(h, told, len(thresholds))
        m = np.bincount(doc[shared], minlength=len(ids)).astype(np.int64)
        may = (n > 0) & (m >= _least(n, percent))
        total, second = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
        np.add.at(total, doc, mix(h))
        np.add.at(second, doc, mix(h ^ np.uint64(0xA0761D6478BD642F)))
        o = np.lexsort((h, common, doc))
        o = o[shared[o]]
        cuts = np.concatenate([[0], np.cumsum(m)])
        # shingles that are surely nobody else's come first in the order and need no index entry
        take = np.maximum(n - _least(n, percent) + 1 - (n - m), 0)
        prefix, members = [], []
        for i in range(len(ids)):
            mine = h[o[cuts[i]:cuts[i + 1]]] if may[i] else None
            prefix.append(None if mine is None else mine[:take[i]].view(np.int64))
            members.append(None if mine is None else np.sort(mine).tobytes())
        return pd.DataFrame({"doc_id": np.array(ids, np.int64), "n": n, "a": total.view(np.int64), "b": second.view(np.int64),
                             "prefix": prefix, "members": members})

    told = shards.answers(batches.applyInPandas(count, PLACES), thresholds)
    return (batches.cogroup(told.groupBy("batch"))
            .applyInPandas(emit, "doc_id long, n long, a long, b long, prefix array<long>, members binary"))


def _met_twice(chosen: DataFrame):
    """A test of a shingle: whether the prefixes of two of the ``chosen`` sets
    may hold it.  False for what is surely in one, so that it need not move."""
    spark = chosen.sparkSession
    sketch = Sketch(chosen.agg(F.sum(F.size("prefix"))).first()[0] or 0, depth=2)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for p in b["prefix"]:
                held.append(np.asarray(p, np.int64).view(np.uint64))
                n += len(held[-1])
                if n >= 1 << 20:
                    yield sketch.partial(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield sketch.partial(np.concatenate(held))

    bits = spark.sparkContext.broadcast(sketch.merge(chosen.select("prefix").mapInPandas(tidy(count), SCHEMA), staged=True)[0])

    def test(t: pd.Series) -> pd.Series:
        return pd.Series(sketch.reaches(bits.value, t.to_numpy(np.int64).view(np.uint64)))

    return F.pandas_udf(test, "boolean")


@F.pandas_udf(LongType())
def _overlap(x: pd.Series, y: pd.Series) -> pd.Series:
    def both(p: bytes, q: bytes) -> int:
        p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        if len(p) > len(q):
            p, q = q, p
        if not len(p):
            return 0
        return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return pd.Series([both(p, q) for p, q in zip(x, y)], dtype="int64")


@F.pandas_udf(StructType([StructField(f"w{i}", LongType()) for i in range(WORDS)]))
def _parities(members: pd.Series) -> pd.DataFrame:
    """For each cell whether an odd number of the members lie there."""
    out = np.zeros((len(members), WORDS), np.uint64)
    for i, m in enumerate(members):
        h = mix(np.frombuffer(m, np.uint64))
        odd = np.bincount((h % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1
        out[i] = np.packbits(odd).view(np.uint64)
    return pd.DataFrame(out.view(np.int64), columns=[f"w{i}" for i in range(WORDS)])


def _apart(p: str, q: str) -> Column:
    """Members that only one of two sets has, at least: what both have leaves no trace."""
    return reduce(add, [F.bit_count(F.col(f"{p}.w{i}").bitwiseXOR(F.col(f"{q}.w{i}"))) for i in range(WORDS)])


def _alike(n: Column, m: Column, n2: Column, m2: Column, apart: Column, percent: int) -> Column:
    """Sets of ``n`` and ``n2`` shingles, of which ``m`` and ``m2`` may be in other
    documents, may reach the threshold if these differ by ``apart`` at least."""
    return (m + m2 - apart) * (100 + percent) >= (n + n2) * (2 * percent)


def _fits(n: Column, m: Column, percent: int) -> Column:
    """The sizes alone allow the threshold."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent)


def _meets(n: Column, at: Column, m: Column, at2: Column, percent: int) -> Column:
    """Sets of ``n`` and ``m`` shingles whose first common one lies at ``at``
    and ``at2`` of their orders may still reach the threshold.  A pair that
    links passes in the list of its first common shingle."""
    return F.least(n - at, m - at2) * (100 + percent) >= (n + m) * percent


def _linked(o: Column, n: Column, m: Column, percent: int) -> Column:
    return o * 100 >= (n + m - o) * percent


def components(links: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """doc_id, component: the smallest id reachable over ``links`` (x, y), and
    over what ``label``, an earlier answer, has connected."""
    if label is not None:
        # only components are connected anew: a far smaller graph than the documents'
        of = label.select(F.col("doc_id").alias("x"), F.col("component").alias("cx"))
        links = (links.join(of, "x", "left").join(of.toDF("y", "cy"), "y", "left")
                 .select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y"))
    edges = stage(links.select(F.col("x").alias("v"), F.col("y").alias("w")).unionByName(
        links.select(F.col("y").alias("v"), F.col("x").alias("w"))).distinct(), "edges")
    own = stage(edges.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("l")), "labels")
    moved = not own.isEmpty()
    while moved:
        near = edges.join(own.select(F.col("v").alias("w"), F.col("l").alias("lw")), "w").groupBy("v").agg(F.min("lw").alias("lw"))
        step = own.join(near, "v").select("v", F.least("l", "lw").alias("l"), F.col("l").alias("was"))
        # and on to where the label's own label points
        up = own.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        step = stage(step.join(up, "l", "left").select("v", F.least("l", F.coalesce("ll", "l")).alias("l"), "was"), "labels")
        moved = not step.where("l <> was").isEmpty()
        own = step.select("v", "l")
    found = own.select(F.col("v").alias("doc_id"), F.col("l").alias("component"))
    if label is None:
        return found
    old = (label.join(own.withColumnRenamed("v", "component"), "component", "left")
           .select("doc_id", F.coalesce("l", "component").alias("component")))
    return stage(old.unionByName(found.join(label.select("doc_id"), "doc_id", "left_anti")), "components")


def join_sets(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every doc_id of ``docs``.

    Words are lower-cased in A-Z only and lie between \\x20 and \\x09-\\x0D;
    fewer words than ``gram`` are one shingle.  Null and empty texts are the
    empty set and link with nothing.  A doc_id that is repeated gives one row,
    with the largest of its sets' sizes, linked by what any of its texts links
    with; rows without doc_id take no part and give no row.  Equal texts have
    one set and one component, the smallest doc_id of all that links reach.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = pick(docs, doc_id="long", text="string")
    sets = stage(_digests(d.where("doc_id is not null"), gram, percent).withColumn("row", F.monotonically_increasing_id()), "sets", clean=True)
    may = sets.where("prefix is not null")
    classes = stage(may.groupBy("a", "b", "n").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "row")).alias("f")).select("a", "b", "n", "f.rep", "f.row"), "classes", clean=True)
    # Joins of sets and lists are merge joins at every size: the driver holds no broadcast of them, and shuffles grow in proportion.
    # One doc_id may be given twice, with two texts: its sets are the classes of one document
    owns = may.select("doc_id", "a", "b", "n").join(classes.drop("row").hint("merge"), ["a", "b", "n"]).select("doc_id", "rep").distinct()
    owns = stage(owns, "owns", clean=True)
    # one row of each class, picked by its number: sets are moved once at most
    chosen = stage(may.join(classes.select("row").hint("merge"), "row", "left_semi")
                   .select(F.struct(F.col("doc_id").alias("id"), "a").alias("s"), F.col("n").cast("int").alias("n"), F.expr("octet_length(members) div 8").cast("int").alias("m"), "prefix", "members", _parities("members").alias("bits")), "chosen", clean=True)

    # the order's first shingles, surely nobody else's, have no entry: positions count them all the same
    index = chosen.select(F.posexplode("prefix").alias("k", "t"), "s", "n", "m", "bits")
    index = index.select("t", "s", "n", "m", "bits", (F.col("n") - F.col("m") + F.col("k")).alias("at")).where(_met_twice(chosen)("t"))
    alone = index.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    lists = stage(index.join(alone.hint("merge"), "t").select("t", "s", "n", "m", "bits", "at"), "lists", clean=True)
    links = owns.where("doc_id <> rep").select(F.col("doc_id").alias("x"), F.col("rep").alias("y"))
    answers = None  # what leaders are known to share: s, leader, o, nl
    label = None
    for round_ in range(LEADERS + 1):
        at = lists.withColumn("id", F.col("s.id"))
        at = at if label is None else at.join(label.select(F.col("doc_id").alias("id"), "component").hint("merge"), "id", "left")
        at = at.withColumn("component", F.coalesce("component", "id") if label is not None else F.col("id"))
        last = round_ == LEADERS or (round_ > 0 and _few_open(at))
        # the first leader is the smallest id; later ones come from the other end, sets no leader has linked
        first = F.struct(F.lit(0), F.lit(0), "id", "s") if round_ == 0 else F.struct(F.bitwise_not("component"), F.xxhash64(F.lit(round_), "s"), "id", "s")
        spread = at.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                     F.min_by(F.struct("s", "id", "n", "m", "bits", "at", "component"), first).alias("l")).where("lo <> hi")
        if last:
            pairs = _open_pairs(at.join(spread.select("t").hint("merge"), "t"), percent)
            pairs = pairs.where("s <> s2").dropDuplicates(["s", "s2"])
            if answers is not None:
                pairs = _undecided(pairs, answers, percent)
        else:
            apart = _apart("bits", "l.bits")
            pairs = at.join(spread.select("t", "l").hint("merge"), "t").where((F.col("component") != F.col("l.component")) & _fits(F.col("n"), F.col("l.n"), percent)
                                              & _meets(F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at"), percent)
                                              & _alike(F.col("n"), F.col("m"), F.col("l.n"), F.col("l.m"), apart, percent))
            far = F.lit(0) if round_ == 0 else apart
            pairs = pairs.select("s", "id", "n", F.col("l.s").alias("s2"), F.col("l.id").alias("id2"), F.col("l.n").alias("n2"), far.alias("far")).where("s <> s2")
        if answers is not None:
            asked = answers.select("s", F.col("leader").alias("s2"))
            pairs = pairs.join(asked.unionByName(asked.select(F.col("s2").alias("s"), F.col("s").alias("s2"))), ["s", "s2"], "left_anti")
        if not last:
            # one leader for each set and round, the smallest of its lists', later the nearest one
            pairs = (pairs.groupBy("s", "id", "n").agg(F.min(F.struct("far", "id2", "s2", "n2")).alias("l"))
                     .select("s", "id", "n", "l.s2", "l.id2", "l.n2"))
        pairs = stage(pairs, f"pairs{round_}", clean=True)
        if pairs.isEmpty():
            if last:
                break
            continue  # a later round may still find some
        x = chosen.select("s", F.col("members").alias("mx"))
        y = (chosen.select(F.col("s").alias("s2"), F.col("members").alias("my"))
             .join(pairs.select("s2").distinct().hint("merge"), "s2", "left_semi"))  # only sets that are asked for move
        done = stage(pairs.join(x.hint("merge"), "s").join(y.hint("merge"), "s2").select("s", "id", "n", F.col("s2").alias("leader"), "id2", F.col("n2").alias("nl"), _overlap("mx", "my").alias("o")), f"answers{round_}", clean=True)
        answers = done if answers is None else answers.unionByName(done)
        new = done.where(_linked(F.col("o"), F.col("n"), F.col("nl"), percent)).select(F.col("id").alias("x"), F.col("id2").alias("y")).where("x <> y")
        label = components(links.unionByName(new) if label is None else new, label)
        if last:
            break
    if label is None:
        label = components(links)
    return (sets.groupBy("doc_id").agg(F.max("n").alias("n_shingles")).join(label, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def _few_open(lists: DataFrame) -> bool:
    """Whether the lists hold ``FEW`` pairs an entry, or less, of members in
    different components (whatever their sizes), by counts."""
    of = lists.groupBy("t", "component").agg(F.count("*").alias("c"))
    of = of.groupBy("t").agg(F.sum("c").alias("n"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
    got = of.agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).first()
    return (got["pairs"] or 0) <= FEW * (got["n"] or 0)


def _open_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list's members in different components.  The smaller set of a
    pair (``n2``) must hold the shingle near its front; it meets the sets of its
    own size block and of the next one (a block is as wide as sizes may differ)."""
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    m = lists.withColumn("block", block)
    front = m.where(_meets(F.col("n"), F.col("at"), F.col("n"), F.col("at"), percent))
    other = front.select("t", *[F.col(c).alias(f"{c}2") for c in ("s", "id", "n", "m", "bits", "at", "component")],
                         F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"))
    p = m.join(other.hint("merge"), ["t", "block"]).where((F.col("component") != F.col("component2")) & (F.struct("n2", "s2") < F.struct("n", "s"))
                                            & _fits(F.col("n"), F.col("n2"), percent)
                                            & _meets(F.col("n"), F.col("at"), F.col("n2"), F.col("at2"), percent)
                                            & _alike(F.col("n"), F.col("m"), F.col("n2"), F.col("m2"), _apart("bits", "bits2"), percent))
    return p.select("s", "id", "n", "s2", "id2", "n2")


def _undecided(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Pairs that no leader's answers rule out."""
    a = answers.select("s", "leader", "o", "nl")
    both = (pairs.join(a.select("s", "leader", F.col("o").alias("ox")), "s")
            .join(a.select(F.col("s").alias("s2"), "leader", F.col("o").alias("oy")), ["s2", "leader"]))
    most = F.least(F.col("ox") + F.col("n2") - F.col("oy"), F.col("oy") + F.col("n") - F.col("ox"))
    out = both.where(~_linked(F.least(most, "n", "n2"), F.col("n"), F.col("n2"), percent)).select("s", "s2").distinct()
    return pairs.join(out, ["s", "s2"], "left_anti")


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id."""
    gone = join_sets(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(stage(gone, "copies"), "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
