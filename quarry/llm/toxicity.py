"""Toxicity by weak supervision.

Voters are words of a small lexicon, groups of word beginnings found in a
bounded sample of labelled rows, and text patterns.  A generative label model
gives every voter a firing rate among toxic and among other documents, fitted
by expectation maximisation over the votes of all documents, and divides the
weight of voters that fire together within a class.  Its posteriors, not the
labels, train a linear classifier on word beginnings, which scores all.

A word beginning is a number: the first 4 to 8 bytes of a lower-cased word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import mix, pick, prepare, release, stage

LEXICON = ("idiot", "moron", "stupid", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting",
           "dumb", "ugly", "garbage", "jerk", "hate", "vermin")
SHORTEST, LONGEST = 4, 8  # bytes of a beginning
MAX_LABELLED = 20_000  # labelled rows that beginnings are looked for in
MAX_TRAINED = 8_000  # of those, rows the classifier is trained on
MAX_STEMS, STEM_VOTERS = 320, 36  # beginnings, and voters they are dealt to
LEAST_DOCS = 3  # rows trained on that must hold a feature
DIMS = 1 << 18
THRESHOLD = 0.7
PATTERNS = ("shouting", "exclaiming", "short")


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learned: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


# -------------------------------------------------------------------- words

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(LONGEST + 1)], np.uint64)  # the first n bytes


def number(word: str) -> int:
    """A word's beginning of at most LONGEST bytes."""
    return int.from_bytes(word.lower().encode()[:LONGEST], "little")


class Words:
    """The words of some texts: the text each is in, its first bytes, how many."""

    def __init__(self, texts: list[str]):
        low = [t.lower().encode("utf-8", "replace") for t in texts]
        a = np.frombuffer(b"\n" + b"\n".join(low) + b"\n" + bytes(LONGEST), np.uint8)
        letter = _LETTER[a]
        start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        first = np.zeros(len(start), np.uint64)
        for j in range(LONGEST):
            first |= a[start + j].astype(np.uint64) << np.uint64(8 * j)
        self.size = np.minimum(end - start, LONGEST)
        self.first = first & _KEEP[self.size]
        at = np.cumsum([1] + [len(x) + 1 for x in low])
        self.text = np.searchsorted(at, start, "right") - 1
        self.n = len(texts)
        marks = np.concatenate([[0], np.cumsum(a == 33, dtype=np.int32)])
        # capitals are the bytes that lower-casing changes, where it keeps the length
        raw = [t.encode("utf-8", "replace") for t in texts]
        odd = {i: sum(map(str.isupper, texts[i])) for i, (x, y) in enumerate(zip(raw, low)) if len(x) != len(y)}
        changed = np.frombuffer(b"\n" + b"\n".join(y if i in odd else x for i, (x, y) in enumerate(zip(raw, low))) + b"\n" + bytes(LONGEST), np.uint8) != a
        capitals = np.concatenate([[0], np.cumsum(changed, dtype=np.int32)])
        shouted = capitals[at[1:] - 1] - capitals[at[:-1]]
        for i, n in odd.items():
            shouted[i] += n
        size = np.diff(at) - 1
        bangs = marks[at[1:] - 1] - marks[at[:-1]]
        self.patterns = np.stack([2 * shouted > np.maximum(size, 20), (bangs > 3) & (bangs * 60 > size), size < 200])

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, beginning) pairs, those of one text once."""
        text, keys = [], []
        for n in range(SHORTEST, LONGEST + 1):
            long = self.size >= n
            text.append(self.text[long])
            keys.append(self.first[long] & _KEEP[n])
        t, k = np.concatenate(text), np.concatenate(keys)
        _, once = np.unique(mix(k ^ (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
        return t[once], k[once]

    def hits(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, index into the sorted ``wanted``) of beginnings met, once each."""
        if not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        heads = np.zeros(1 << 16, bool)
        spot = lambda x: ((x & _KEEP[SHORTEST]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        heads[spot(wanted)] = True
        may = np.flatnonzero(heads[spot(self.first)])
        first, size, text = self.first[may], self.size[may], self.text[may]
        pairs = []
        for n in range(SHORTEST, LONGEST + 1):
            long = size >= n
            k = first[long] & _KEEP[n]
            i = np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)
            same = wanted[i] == k
            pairs.append(text[long][same] * len(wanted) + i[same])
        p = np.unique(np.concatenate(pairs))
        return p // len(wanted), p % len(wanted)


def _small(batches: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Batches of about ``most`` characters of text; what a task held on to
    goes back to the system when it ends, as workers are used again."""
    release()
    for b in batches:
        size = b["text"].str.len().cumsum().to_numpy()
        cuts = np.searchsorted(size, np.arange(most, int(size[-1]) if len(size) else 0, most), "right")
        for s, e in zip([0, *cuts], [*cuts, len(b)]):
            if e > s:
                yield b.iloc[s:e].reset_index(drop=True)
    release()


# ------------------------------------------------------------------- voters

def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _small(batches):
        text, key = Words(list(b["text"])).beginnings()
        keys, i = np.unique(key, return_inverse=True)
        toxic = b["toxic"].to_numpy()[text] == 1
        pos = np.bincount(i[toxic], minlength=len(keys))
        yield pd.DataFrame({"stem": keys.view(np.int64), "pos": pos, "neg": np.bincount(i, minlength=len(keys)) - pos})


def find_stems(labelled: DataFrame, most: int = MAX_STEMS, least_z: float = 5.0) -> list[int]:
    """Word beginnings that labelled toxic documents hold far more often than
    chance, the strongest first; none that begins with a chosen one."""
    n, pos = labelled.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return []
    rate = pos / n
    c = labelled.mapInPandas(_stem_counts, "stem long, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = F.col("pos") + F.col("neg")
    c = c.withColumn("z", (F.col("pos") - both * rate) / F.sqrt(both * (rate * (1 - rate))))
    best = c.where((F.col("z") >= least_z) & (F.col("pos") >= 0.8 * both)).orderBy(F.desc("z"), "stem").limit(4 * most).collect()
    # ties between a beginning and a longer one go to the shorter
    names = sorted(((r["z"], r["stem"] & (1 << 64) - 1) for r in best), key=lambda x: (-x[0], x[1].bit_length(), x[1]))
    covers = lambda s, t: t & (1 << (s.bit_length() + 7) // 8 * 8) - 1 == s
    chosen = [number(w) for w in LEXICON]
    for _, stem in names:
        if not any(covers(s, stem) or covers(stem, s) for s in chosen):
            chosen.append(stem)
    return chosen[len(LEXICON):][:most]


class Voters:
    """Lexicon words, groups of found beginnings, patterns, and silence of the
    first two; a bit of a mask each."""

    def __init__(self, stems: list[int]):
        groups = min(STEM_VOTERS, len(stems))
        bit = {number(w): i for i, w in enumerate(LEXICON)}
        bit |= {s: len(LEXICON) + i % groups for i, s in enumerate(stems)}
        self.wanted = np.array(sorted(bit), np.uint64)
        self.bits = np.array([bit[int(k)] for k in self.wanted], np.int64)
        self.finding = len(LEXICON) + groups  # voters that speak for toxic only
        self.count = self.finding + len(PATTERNS) + 1

    def masks(self, words: Words) -> np.ndarray:
        out = np.zeros(words.n, np.int64)
        text, i = words.hits(self.wanted)
        np.bitwise_or.at(out, text, np.int64(1) << self.bits[i])
        silent = out == 0
        for k, p in enumerate([*words.patterns, silent]):
            out |= p.astype(np.int64) << (self.finding + k)
        return out


# -------------------------------------------------------------- label model

@dataclass
class LabelModel:
    """Rates at which voters fire, by class; ``share`` lowers correlated voters."""

    prior: float
    rates: np.ndarray  # 2 x voters
    share: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """A voter that doesn't fire says nothing."""
        on = np.log(self.rates[1] / self.rates[0])
        logit = np.log(self.prior / (1 - self.prior)) + fired @ (on * self.share)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _fired(masks: np.ndarray, m: int) -> np.ndarray:
    return ((masks[:, None] >> np.arange(m, dtype=np.int64)) & 1).astype(np.float64)


def fit_label_model(votes: DataFrame, m: int, finding: int, rounds: int = 5) -> LabelModel:
    """``votes``: mask, toxic (null: no label to use), n documents.  Labelled
    rows keep their class; each round is one pass with one row per task back."""

    def totals(model: LabelModel | None, moments: bool) -> list[np.ndarray]:
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                fired, n = _fired(b["mask"].to_numpy(), m), b["n"].to_numpy(np.float64)
                known = b["toxic"].notna().to_numpy()
                p = np.where(known, b["toxic"].fillna(0).to_numpy(np.float64), 0.0 if model is None else model.posterior(fired))
                n = np.where(known, n, 0.0) if model is None else n
                sums = [np.array([(n * (1 - p)).sum(), (n * p).sum()]), (n * (1 - p)) @ fired, (n * p) @ fired]
                if moments:
                    sums += [(fired.T * (n * q)) @ fired for q in (1 - p, p)]
                yield pd.DataFrame({"sums": [np.concatenate([x.ravel() for x in sums])]})
        rows = votes.mapInPandas(run, "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        flat = np.zeros(2 + 2 * m + 2 * m * m * moments)
        for r in rows.collect():  # as many numbers as the model has
            flat[r["i"]] = r["x"]
        cuts = np.cumsum([2, m, m] + [m * m] * (2 * moments))[:-1]
        return np.split(flat, cuts)

    def model_of(t) -> LabelModel:
        count = t[0]
        rates = np.clip((np.stack(t[1:3]) + 0.5) / (count[:, None] + 20), 1e-5, 1 - 1e-5)
        rates[1, :finding] = np.maximum(rates[1, :finding], rates[0, :finding])
        return LabelModel(float(np.clip((count[1] + 1) / (count.sum() + 10), 1e-3, 0.5)), rates, np.ones(m))

    model = model_of(totals(None, False))
    for _ in range(rounds):
        model = model_of(totals(model, False))
    t = totals(model, True)
    together = np.zeros((m, m))
    for k in (0, 1):  # correlations within a class
        n = max(t[0][k], 1.0)
        mean = t[1 + k] / n
        cov = t[3 + k].reshape(m, m) / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        together = np.maximum(together, cov / np.outer(sd, sd))
    together[np.arange(m), np.arange(m)] = 0
    model.share = 1 / (1 + np.where(together > 0.5, together, 0).sum(axis=1))
    return model


# --------------------------------------------------------------- classifier

def telling(features: list[np.ndarray], target: np.ndarray, least_z: float = 4.0) -> np.ndarray:
    """Features whose documents' mean target is far from the overall mean."""
    n, t, rate = np.zeros(DIMS), np.zeros(DIMS), float(np.clip(target.mean() if len(target) else 0, 1e-3, 1 - 1e-3))
    for f, p in zip(features, target):
        n[f] += 1
        t[f] += p
    return np.abs(t - n * rate) >= least_z * np.sqrt(np.maximum(n, 1) * rate * (1 - rate))


def train_linear(features: list[np.ndarray], target: np.ndarray, epochs: int = 8) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature numbers, by AdaGrad."""
    w, g, rng = np.zeros(DIMS), np.full(DIMS, 1e-2), np.random.default_rng(11)
    bias, gb = -2.0, 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(features)):
            f = features[i]
            p = 1 / (1 + np.exp(-np.clip(bias + w[f].sum(), -30, 30)))
            e = p - target[i]
            if abs(e) < 1e-3:
                continue
            g[f] += e * e
            w[f] -= 0.2 * (e + 1e-3 * w[f]) / np.sqrt(g[f])
            gb += e * e
            bias -= 0.2 * e / np.sqrt(gb)
    w[np.abs(w) < 0.1] = 0  # what hardly weighs is not looked up
    return w, bias


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_trained: int = MAX_TRAINED) -> DataFrame:
    """``docs`` with score (0 to 1) and held_out; other columns pass through
    (a ``score`` or ``held_out`` of their own is replaced).

    ``labels``: doc_id, toxic; rows with nulls and of held-out documents are
    not learned from, and of the rest at most ``max_labelled`` (by a hash of
    the id).  Null and empty texts have no words and get the score of the
    patterns and the bias alone.  Repeated rows count as often as they occur.
    Without labels of both classes the lexicon and the patterns vote alone.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    d = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    labelled = stage(d.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "labelled-texts")
    voters = Voters(find_stems(labelled))

    def vote(batches):
        for b in _small(batches):
            yield pd.DataFrame({"doc_id": b["doc_id"], "mask": voters.masks(Words(list(b["text"])))})

    masks = d.mapInPandas(vote, "doc_id long, mask long").join(F.broadcast(sample), "doc_id", "left")
    votes = stage(masks.groupBy("mask", "toxic").agg(F.count("*").alias("n")), "votes")
    model = fit_label_model(votes, voters.count, voters.finding)

    def posteriors(batches):
        for b in _small(batches):
            words = Words(list(b["text"]))
            text, key = words.beginnings()
            f = (mix(key) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int32)
            order = np.argsort(text, kind="stable")
            cuts = np.cumsum(np.bincount(text, minlength=words.n))[:-1]
            yield pd.DataFrame({"p": model.posterior(_fired(voters.masks(words), voters.count)),
                                "f": [np.unique(x).tobytes() for x in np.split(f[order], cuts)]})

    # rows are chosen by their numbers, without their texts
    labelled = labelled.withColumn("key", F.xxhash64("doc_id", F.lit(1)))
    last = labelled.select("key").orderBy("key").limit(max_trained).agg(F.max("key")).first()[0]
    some = stage(labelled.where(F.col("key") <= F.lit(last)).drop("key").limit(max_trained), "trained")
    rows = some.mapInPandas(posteriors, "p double, f binary").collect()  # max_trained rows
    features, target = [np.frombuffer(r["f"], np.int32) for r in rows], np.array([r["p"] for r in rows])
    use = telling(features, target)
    weights, bias = train_linear([f[use[f]] for f in features], target)

    def named(batches):
        for b in _small(batches):
            _, key = Words(list(b["text"])).beginnings()
            w = weights[(mix(key) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int32)]
            yield pd.DataFrame({"k": key[w != 0].view(np.int64), "w": w[w != 0]})

    kept = (some.mapInPandas(named, "k long, w double").groupBy("k").agg(F.max("w").alias("w"), F.count("*").alias("n"))
            .where(F.col("n") >= LEAST_DOCS).collect())  # features of max_trained rows
    keys = np.array([r["k"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(keys)
    linear = spark.sparkContext.broadcast((keys[order], np.array([r["w"] for r in kept])[order], bias))

    @F.pandas_udf("double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted, w, b = linear.value
        for t in texts:
            logits = [np.zeros(0)]
            for part in _small(iter([pd.DataFrame({"text": t})])):
                text, i = Words(list(part["text"])).hits(wanted)
                logits.append(b + np.bincount(text, w[i] if len(i) else None, minlength=len(part)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(logits), -30, 30))))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", judge(text))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                   spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score stays under the threshold."""
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("score") < THRESHOLD).select("doc_id", "text", "lang", "source", "n_chars")
