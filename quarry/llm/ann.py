"""Approximate nearest neighbours by NN-descent.

Equal vectors are one node.  The first neighbours come from blocks of vectors
that lie on the same sides of random planes; then neighbours of neighbours are
joined round by round: the neighbours of a node, both ways, are compared with
each other, and every node keeps its nearest, until hardly an edge changes.
Rounds and walks move vectors as one byte a component; the distances that count
are taken from the doubles.  Queries walk the finished graph greedily, a beam of
best nodes at a time, until no node of the beam is left to leave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from quarry.llm.common import pick, prepare, running_start, stage

NEIGHBOURS = 40  # kept per node
STILL = 0.05  # share of edges that may change in the last round
LINES, PLANES, BLOCK = 4, 20, 256
BEAM, LEAVE = 160, 64  # nodes remembered by a walk, and left in one hop


def _prepared(vectors: DataFrame, lines: int) -> DataFrame:
    """id, a, b (digest of the vector), vec (doubles), code and scale (one signed
    byte a component), one key per line; rows that take part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}  # for each length of vectors, alike in all tasks
        for b in batches:
            ids, vecs, keys, codes, scales = [], [], [], [], []
            for i, v in zip(b["id"], b["vec"]):
                x = np.array([np.nan if c is None else c for c in v], np.float64)
                if not (len(x) and np.isfinite(x).all() and x.any()):
                    continue
                if len(x) not in planes:
                    if len(planes) >= 16:
                        planes.clear()
                    g = np.random.default_rng(len(x)).normal(size=(lines, PLANES, len(x)))
                    # an offset that all components share moves no vector across
                    planes[len(x)] = g - g.mean(axis=2, keepdims=True) if len(x) > 1 else g
                ids.append(i)
                vecs.append(x + 0.0)  # -0.0 becomes 0.0
                scales.append(np.abs(x).max())
                unit = x / scales[-1]
                codes.append(np.rint(unit * 127).astype(np.int8).tobytes())
                keys.append(((planes[len(x)] @ unit) > 0) @ (1 << np.arange(PLANES - 1, -1, -1)))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in vecs]
            yield pd.DataFrame({"id": np.array(ids, np.int64), "a": [int.from_bytes(d[:8], "big", signed=True) for d in digests],
                                "b": [int.from_bytes(d[8:], "big", signed=True) for d in digests], "size": [len(x) for x in vecs],
                                "vec": [x.tobytes() for x in vecs], "code": codes, "scale": np.array(scales, np.float64)}
                               | {f"line{k}": np.array([y[k] for y in keys], np.int64) for k in range(lines)})
    schema = "id long, a long, b long, size int, vec binary, code binary, scale double" + "".join(f", line{k} long" for k in range(lines))
    return vectors.where("id is not null and vec is not null").mapInPandas(run, schema)


def _square(codes: list[bytes], scales: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, from the codes."""
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    dot = (x @ x.T).astype(np.float64)
    step = np.asarray(scales, np.float64) / 127
    n = np.diag(dot) * step * step
    d = np.maximum(n[:, None] + n[None, :] - 2 * dot * step[:, None] * step[None, :], 0)
    np.fill_diagonal(d, np.inf)
    return d


def _met(keep: int):
    """Pairs among the members of each row: every member's ``keep`` nearest that
    are new and nearer than the worst it has."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            src, dst, dist = [], [], []
            for ids, codes, scales, worst, new in zip(b["ids"], b["codes"], b["scales"], b["worst"], b["new"]):
                ids = np.asarray(ids, np.int64)
                if len(ids) < 2:
                    continue
                d = _square(codes, scales)
                new = np.asarray(new, bool)
                d[np.ix_(~new, ~new)] = np.inf
                d[d >= np.asarray(worst, np.float64)[:, None]] = np.inf
                k = min(keep, len(ids) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                i = np.repeat(np.arange(len(ids)), k)
                j = near.ravel()
                ok = np.isfinite(d[i, j])
                src.append(ids[i[ok]])
                dst.append(ids[j[ok]])
                dist.append(d[i[ok], j[ok]])
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "d": np.concatenate(dist)})
    return run


def _best(edges: DataFrame, by: str, keep: int) -> DataFrame:
    other = "dst" if by == "src" else "src"
    w = Window.partitionBy(by).orderBy("d", other)
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def _rows(members: DataFrame) -> DataFrame:
    return members.select(*[F.col(f"m.{c}").alias(a) for c, a in (("u", "ids"), ("code", "codes"), ("scale", "scales"), ("worst", "worst"), ("new", "new"))])


# Joins inside the loops are merge joins: the driver would hold a broadcast of each turn
# until its next collection.
def build_graph(nodes: DataFrame, neighbours: int = NEIGHBOURS, still: float = STILL, lines: int = LINES) -> DataFrame:
    """src, dst, d (squared distance of the codes), new: up to ``neighbours``
    edges of each of ``nodes`` (id, size, code, scale, line0, ...); vectors of one
    length only meet.  Rounds go on while more than the share ``still`` of the
    edges changes."""
    found = None
    for k in range(lines):
        spots = running_start(nodes.select("id", "size", "code", "scale", f"line{k}", F.lit(1).alias("one")), ["size", f"line{k}", "id"], "one", "at")
        blocks = spots.groupBy("size", F.expr(f"at div {BLOCK}").alias("block")).agg(F.collect_list(
            F.struct(F.col("id").alias("u"), "code", "scale", F.lit(float("inf")).alias("worst"), F.lit(True).alias("new"))).alias("m"))
        pairs = _rows(blocks).mapInPandas(_met(neighbours // 2), "src long, dst long, d double")
        found = pairs if found is None else found.unionByName(pairs)
    # one shuffle serves the grouping and the ranking
    graph = stage(_best(found.repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d")), "src", neighbours).withColumn("new", F.lit(True)), "graph")
    while True:
        # the nearest that point here count as neighbours too
        back = _best(graph, "dst", neighbours).select(F.col("dst").alias("v"), F.col("src").alias("u"), "new")
        around = graph.select(F.col("src").alias("v"), F.col("dst").alias("u"), "new").unionByName(back)
        around = around.repartition("v").groupBy("v", "u").agg(F.max("new").alias("new"))
        # where nothing is new nothing can be found
        around = around.withColumn("any", F.max("new").over(Window.partitionBy("v"))).where("any").drop("any")
        worst = graph.groupBy("src").agg(F.max("d").alias("worst"), F.count("*").alias("n")).select(
            F.col("src").alias("u"), F.when(F.col("n") >= neighbours, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = nodes.select(F.col("id").alias("u"), "code", "scale").join(worst.hint("merge"), "u")
        met = around.join(known.hint("merge"), "u").groupBy("v").agg(F.collect_list(F.struct("u", "code", "scale", "worst", "new")).alias("m"))
        pairs = _rows(met).mapInPandas(_met(max(1, neighbours // 5)), "src long, dst long, d double").withColumn("new", F.lit(True))
        both = graph.withColumn("new", F.lit(False)).unionByName(pairs).repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        graph = stage(_best(both, "src", neighbours), "graph")
        changed, edges = graph.agg(F.count_if("new"), F.count("*")).first()
        if changed <= still * edges:
            return graph


def search(graph: DataFrame, nodes: DataFrame, starts: DataFrame, beam: int = BEAM, leave: int = LEAVE) -> DataFrame:
    """q, u, d: the best nodes met on the way from each of ``starts`` (q, a node
    itself), itself among them.  Each hop visits the neighbours, both ways, of
    the ``leave`` nearest nodes in the beam that have not been left yet; the
    walk ends when all have.  d is the distance in doubles."""
    edges = graph.select("src", "dst", "d")
    near = stage(edges.unionByName(_best(edges, "dst", NEIGHBOURS).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d"))
                 .groupBy(F.col("src").alias("u")).agg(F.collect_set("dst").alias("to")), "near")

    def apart(x: pd.Series, sx: pd.Series, y: pd.Series, sy: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        size = np.array([len(p) for p in x])
        out = np.zeros(len(x))
        for n in np.unique(size):  # vectors of one length meet only
            at = np.flatnonzero(size == n)
            p, q = (np.frombuffer(b"".join(c.iloc[at]), np.int8).reshape(len(at), n) * (s.to_numpy()[at, None] / 127) for c, s in ((x, sx), (y, sy)))
            out[at] = ((p - q) ** 2).sum(axis=1)
        return pd.Series(out)

    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(np.sqrt(((np.frombuffer(p, np.float64) - np.frombuffer(q, np.float64)) ** 2).sum())) for p, q in zip(x, y)], dtype="float64")

    about = F.pandas_udf(apart, "double")
    measure = F.pandas_udf(distance, "double")
    codes = nodes.select(F.col("id").alias("u"), "code", "scale")
    own = codes.join(starts.select(F.col("q").alias("u")), "u").toDF("q", "qcode", "qscale")
    at = stage(starts.select("q", F.col("q").alias("u"), F.lit(0.0).alias("d"), F.lit(False).alias("left"), F.lit(True).alias("go")), "beam")
    while not at.where("go").isEmpty():
        step = at.where("go").join(near, "u").select("q", F.explode("to").alias("u")).distinct()
        step = step.join(at.select("q", "u").hint("merge"), ["q", "u"], "left_anti")
        met = step.join(codes.hint("merge"), "u").join(own, "q").select("q", "u", about("qcode", "qscale", "code", "scale").alias("d"), F.lit(False).alias("left"))
        seen = at.select("q", "u", "d", (F.col("left") | F.col("go")).alias("left")).unionByName(met)
        best = seen.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("d", "u"))).where(F.col("_r") <= beam).drop("_r")
        turn = F.row_number().over(Window.partitionBy("q", "left").orderBy("d", "u"))
        at = stage(best.withColumn("go", ~F.col("left") & (turn <= leave)), "beam")
    vecs = nodes.select(F.col("id").alias("u"), "vec")
    mine = vecs.join(starts.select(F.col("q").alias("u")), "u").toDF("q", "qvec")
    return at.select("q", "u").join(vecs, "u").join(mine, "q").select("q", "u", measure("qvec", "vec").alias("d"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by
    ``every``: the ``k`` nearest found among all other rows (all of them, if
    fewer), by Euclidean distance in double precision, ties to the smaller id.

    ``vectors``: vec_id, embedding.  Null vectors, zero vectors and those with
    a null or non-finite component take no part, nor do rows without vec_id;
    of rows that repeat a vec_id one per vector counts.  Vectors of different
    lengths never meet.  Equal vectors are one node of the graph, with its
    ``k`` + 1 smallest ids.  Other columns are ignored.
    """
    prepare(vectors.sparkSession)
    v = stage(_prepared(pick(vectors, vec_id="long", embedding="array<double>").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), LINES), "vectors")
    classes = stage(v.groupBy("a", "b").agg(F.min("id").alias("rep")), "classes")
    ids = v.select("id", "a", "b").distinct().join(classes, ["a", "b"]).select("id", "rep")
    members = ids.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("_r") <= k + 1).select(F.col("rep").alias("u"), "id")
    nodes = stage(v.join(classes.select("a", "b", F.col("rep").alias("id")), ["a", "b", "id"]).dropDuplicates(["id"]).drop("a", "b"), "nodes")
    graph = build_graph(nodes)
    queries = ids.where(F.col("id") % every == 0)
    found = search(graph, nodes, queries.select(F.col("rep").alias("q")).distinct())
    # one more than asked for: a query is among its own finds
    w = Window.partitionBy("q").orderBy("d", "id")
    lists = (found.join(stage(members, "members"), "u").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
             .select(F.col("q").alias("rep"), F.col("id").alias("vec_id"), F.col("d").alias("score")))
    mine = queries.select(F.col("id").alias("query_id"), "rep").join(lists, "rep").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nn_descent(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
