"""URL rules by a cascade of Bloom filters.

A rule is a host suffix with a path prefix.  The keys an url can match are its
host's suffixes with its path's prefixes of the lengths that rules have; all
such keys of a corpus are the universe.  Level 0 holds the listed keys; level 1
the keys of the universe that level 0 takes for listed; level 2 the listed keys
that level 1 takes for those, and so on until a level errs no more.  The first
level that denies a key then decides it, exactly for every key of the universe,
and no url is joined with the list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.common import lower_ascii, pick, prepare, stage

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
BITS_PER_KEY, HASHES = 10, 5
MAX_BITS = 1 << 28  # of one level; more keys than fit are spread over shards


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def candidate_keys(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """Array of the rule strings that could fit, longest first: paths of the
    rules' lengths, hosts of as many labels as a rule has at most."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most_labels - 1)), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths), reverse=True)])
    paths = F.filter(paths, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    keys = F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(keys), lambda a, b: F.length(b) - F.length(a))


class Cascade:
    """Levels of (bits, salt); small enough to travel with the tasks."""

    def __init__(self, shards: int):
        self.shards = shards
        self.levels: list[list[np.ndarray]] = []

    def places(self, h: np.ndarray, level: int, size: int) -> list[np.ndarray]:
        h = h.view(np.uint64)
        a = (h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(29)
        b = (a * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
        return [((a + np.uint64(i) * b) >> np.uint64(11)) % np.uint64(size) for i in range(HASHES)]

    def has(self, h: np.ndarray, level: int) -> np.ndarray:
        """What level ``level`` says of 64-bit key hashes."""
        out = np.zeros(len(h), bool)
        shard = (h.view(np.uint64) % np.uint64(self.shards)).astype(np.int64)
        for s in np.unique(shard):
            bits, mine = self.levels[level][s], np.flatnonzero(shard == s)
            ok = np.ones(len(mine), bool)
            for p in self.places(h[mine], level, len(bits) * 8):
                ok &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            out[mine] = ok
        return out

    def listed(self, h: np.ndarray) -> np.ndarray:
        """Exact membership for every key of the universe."""
        state, open_ = np.zeros(len(h), bool), np.arange(len(h))
        for level in range(len(self.levels)):
            yes = self.has(h[open_], level)
            # denied by an even level: not listed; by an odd one: listed
            state[open_[~yes]] = level % 2 == 1
            open_ = open_[yes]
        state[open_] = len(self.levels) % 2 == 1
        return state


def build_cascade(spark: SparkSession, listed: DataFrame, universe: DataFrame, max_levels: int = 60) -> Cascade:
    """``listed`` and ``universe``: one column ``h``, distinct 64-bit hashes of
    keys.  Every level is merged from the tasks' bit maps; its size follows
    from a count, and levels of more than MAX_BITS are cut into shards."""
    prepare(spark)
    yes = stage(listed.join(universe, "h", "left_semi"), "listed")
    no = stage(universe.join(yes, "h", "left_anti"), "unlisted")
    inside, outside = yes, no
    shards = max(1, -(-yes.count() * BITS_PER_KEY // MAX_BITS))
    cascade, level = Cascade(shards), 0
    while level < max_levels and (n := inside.count()):
        size = -(-max(64, n * BITS_PER_KEY // shards) // 8)
        cascade.levels.append([np.zeros(size, np.uint8) for _ in range(shards)])
        for row in _fill(inside, cascade, level, size).collect():  # as many bytes as the level has
            cascade.levels[level][row["shard"]] |= np.frombuffer(row["bits"], np.uint8)
        wrong = _passed(outside, cascade, level)
        inside, outside, level = stage(wrong, f"cascade{level}"), inside, level + 1
    if inside.count():
        raise ValueError(f"the cascade is not done after {max_levels} levels")
    return cascade


def _fill(keys: DataFrame, cascade: Cascade, level: int, size: int) -> DataFrame:
    """The bit map of each shard, ORed from bytes that are not 0: tasks merge
    their own keys first, a byte of a map is then summed up in one place."""
    shards = cascade.shards

    def marks(batches):
        for b in batches:
            h = b["h"].to_numpy()
            shard = h.view(np.uint64) % np.uint64(shards)
            spot = np.concatenate([shard * np.uint64(size * 8) + p for p in Cascade(shards).places(h, level, size * 8)])
            spot = np.unique(spot)
            at, first = np.unique(spot >> np.uint64(3), return_index=True)
            value = np.bitwise_or.reduceat((1 << (spot & np.uint64(7))).astype(np.int32), first) if len(spot) else spot
            yield pd.DataFrame({"shard": (at // np.uint64(size)).astype(np.int64), "at": (at % np.uint64(size)).astype(np.int64), "value": np.asarray(value, np.int32)})

    def blocks(batches):
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            for s, at, v in zip(b["shard"], b["at"], b["value"]):
                maps.setdefault(s, np.zeros(size, np.uint8))[at] = v
        yield pd.DataFrame({"shard": list(maps), "bits": [m.tobytes() for m in maps.values()]}).astype({"shard": "int64"})

    byte = keys.mapInPandas(marks, "shard long, at long, value int").groupBy("shard", "at").agg(F.bit_or("value").alias("value"))
    return byte.repartition(shards, "shard").mapInPandas(blocks, "shard long, bits binary")


def _passed(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b[cascade.has(b["h"].to_numpy(), level)]
    return keys.mapInPandas(run, "h long")


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest rule that fits decides; without one, rule is null and the
    verdict is ``default``: the cascades deny every key of such an url.  Null
    urls and urls without ``://`` have empty host and path and fit no rule;
    repeated rows are judged alike; other columns are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    lengths = sorted({len(p) for _, p, _ in rules}) or [1]
    most = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    p = pick(pages, page_id="long", url="string")
    host, path = host_path(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths, most))
    universe = stage(p.select(F.explode("keys").alias("key")).distinct().select(F.xxhash64("key").alias("h")).distinct(), "universe")
    cascades = {}
    for verdict in ("allow", "block"):
        keys = [(h + q,) for h, q, v in rules if v == verdict]
        listed = spark.createDataFrame(keys, "key string").select(F.xxhash64("key").alias("h")).distinct()
        cascades[verdict] = build_cascade(spark, listed, universe)

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def decide(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        sizes = keys.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in hashes]) if sizes.sum() else np.zeros(0, np.int64)
        block, allow = cascades["block"].listed(flat), cascades["allow"].listed(flat)
        hit = block | allow
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for i, k in enumerate(keys):
            first = np.flatnonzero(hit[at[i]:at[i + 1]])
            if len(first):
                out.append((k[first[0]], "block" if block[at[i] + first[0]] else "allow"))
            else:
                out.append((None, default))
        return pd.DataFrame(out, columns=["rule", "verdict"])

    judged = p.withColumn("_v", decide("keys", F.transform("keys", lambda k: F.xxhash64(k))))
    return judged.select("page_id", "host", "path", "_v.rule", "_v.verdict")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
