"""Exact dedup, importance resampling and whitening against plain statements."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import exact, resample, whiten

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lowered(text):
    return (text or "").encode().translate(_LOWER)


# ------------------------------------------------------------------ exact dedup

def texts():
    r = random.Random(2)
    pool = [" ".join(r.choice(["Ab", "c", "É", "dd"]) for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = [(i, r.choice(pool)) for i in range(300)]
    rows += [(400 + i, r.choice(["HOT text", "hot TEXT"])) for i in range(200)]
    rows += [(700, None), (701, ""), (702, "É"), (703, "é"), (704, "x" * 3_000_000), (705, "X" * 3_000_000), (706, " "), (707, "İ"), (708, "İ")]
    return rows


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 7, 3, 1) for i, t in rows], "doc_id long, text string, key string, row long, n long, bucket int")


def plain_copies(rows):
    by = {}
    for i, t in rows:
        by.setdefault(lowered(t), []).append(i)
    return sorted((i, max(by[lowered(t)]), len(by[lowered(t)]), i == max(by[lowered(t)]), hashlib.sha256(lowered(t)).hexdigest()) for i, t in rows)


def test_exact_copies(spark):
    got = exact.exact_copies(docs(spark, texts())).select("doc_id", "keep_id", "group_size", "kept", "key").collect()
    assert sorted(map(tuple, got)) == plain_copies(texts())


def test_exact_copies_of_one_key(spark):
    """A digest of two values chains many texts; bytes tell them apart."""
    weak = lambda t: F.hex(F.length(t) % 2)
    got = exact.exact_copies(docs(spark, texts()), digest=weak)
    assert max(r.chain for r in got.select("chain").collect()) > 10
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [x[:4] for x in plain_copies(texts())]


def test_exact_copies_odd_rows(spark):
    assert exact.exact_copies(docs(spark, [])).count() == 0
    rows = [(None, "a"), (None, "A"), (5, "b"), (5, "B"), (5, "c"), (None, "b"), (6, None), (6, None)]
    got = exact.exact_copies(docs(spark, rows)).collect()
    groups = Counter((r.keep_id, r.group_size, r.kept) for r in got)
    assert groups == {(None, 2, True): 1, (None, 2, False): 1, (5, 3, True): 1, (5, 3, False): 2, (5, 1, True): 1, (6, 2, True): 1, (6, 2, False): 1}


def test_directory_splits_overfull_buckets(spark):
    """Half of all keys share their first bits; only their buckets are deep."""
    keys = [f"{i:04x}" for i in range(0, 1 << 16, 64)] + [f"00{i:02x}{i:x}" for i in range(256)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    rows = exact.directory(frame, 10, 100).collect()
    held = Counter()
    bucket = {r.pointer: (r.bucket, r.depth) for r in rows}
    for k in keys:
        held[bucket[int(k[:4].ljust(4, "0"), 16) >> 6]] += 1
    assert sum(held.values()) == len(keys) and len({d for _, d in held}) > 2
    for (b, d), n in held.items():
        assert n <= 100 or d == 10
        if d:  # its parent was over the capacity
            assert sum(m for (c, _), m in held.items() if c >> (11 - d) == b >> (11 - d)) > 100


# ------------------------------------------------------------------ resampling

def plain_features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return w, [b" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_draw(rows, items):
    bucket = lambda f: zlib.crc32(f) % 10000
    s = Counter(bucket(f) for _, t in rows for f in plain_features(t)[1])
    t = Counter(bucket(f) for x in items for f in plain_features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in s}
    out = {}
    for i, x in rows:
        w, f = plain_features(x)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in f)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)]
    fit = sorted((i for i in out if out[i][3] >= 20), key=lambda i: (-out[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(fit[:5 * len(fit) // 100])}
    return {i: (*v[:3], rank.get(i)) for i, v in out.items()}


def corpus():
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "x" * 47, "y" * 48, "z" * 49, "q" * 200, "日本語" * 30, "A1"]
    rows = [(i, r.choice([" ", "--", "\n", " \x7f "]).join(r.choice(words) for _ in range(r.choice([3, 19, 20, 25, 60])))) for i in range(400)]
    return rows + [(500, None), (501, ""), (502, "?!"), (503, "one"), (504, "two words"), (505, "-" + "long" * 60_000 + " end"), (506, "word " * 500_000)]


def test_resample(spark):
    rows, items = corpus(), ["w1 w2 w3 w4", "Été w7 " + "q" * 200 + " w1", None, ""]
    target = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rank int, score int")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in resample.resample(frame, target).collect()}
    assert got == plain_draw(rows, items)


def test_resample_odd_rows(spark):
    target = spark.createDataFrame([], "item_id long, text string")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert resample.resample(frame([]), target).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    got = resample.resample(frame([(None, text)] * 30 + [(1, text)] * 30 + [(None, None)]), target, percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 31)) and len(got) == 61
    assert {r.n_features for r in got} == {87, 0}


@pytest.mark.parametrize("segments", [1, 3, 8])
def test_sorted_ranks(spark, segments):
    """Exact ranks with many ties; no segment holds much over its share."""
    r = random.Random(4)
    rows = [(r.randint(0, 5), r.choice([None, 1, 2, 3]), 9) for _ in range(900)] + [(3, 2, 9)] * 600
    got = resample.sorted_ranks(spark.createDataFrame(rows, "score long, doc_id long, _other int").repartition(5), segments).collect()
    assert sorted(x.rank for x in got) == list(range(1, 1501))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    assert [key(x) for x in sorted(got, key=lambda x: x.rank)] == sorted(map(key, rows))


# ------------------------------------------------------------------- whitening

def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2) for i, v in rows],
                                 "vec_id long, embedding array<double>, n int, whitened int")


def plain_whiten(rows, want=4):
    ok = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in ok]
    fit = np.array(sorted({tuple(v) for _, v in x}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    keep = [k for k in np.argsort(-e)[:want] if e[k] > 1e-9 * max(e.max(), 1e-300)]
    out = {}
    for i, v in x:
        v = np.array(v)
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
        for k, j in enumerate(keep):
            out[i, k + 1] = (n, dev, (v - s / n) @ q[:, j] / math.sqrt(e[j]), e[j] / e.sum())
    return out


def compare(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        n, dev, w, part = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and abs(r.explained / part - 1) < 1e-9 and r.identity_error < 1e-9
        sign = signs.setdefault(r.component, math.copysign(1, w * r.whitened))
        assert abs(r.whitened - sign * w) < 1e-8 * max(1, abs(w))


def test_whiten(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 24)) * np.linspace(0.05, 1, 24) @ r.normal(size=(24, 24))
    rows = [(i, list(v)) for i, v in enumerate(x)] + [(900 + i, list(x[3])) for i in range(300)]
    rows += [(2000, None), (2001, [None] + [0.1] * 23), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, [0.0] * 24), (2005, [-0.0] * 24)]
    compare(whiten.whiten(vectors(spark, rows)).collect(), plain_whiten(rows))


def test_whiten_few_dimensions(spark):
    """Fewer components than asked for, and close but different variances."""
    rows = [(i, [0.1 * i, 0.2 * i, 1.0]) for i in range(20)]
    compare(whiten.whiten(vectors(spark, rows)).collect(), plain_whiten(rows))
    rows = [(2 * k + s, [(1 - 2 * s) * (1 + k / 64) if j == k else 0.0 for j in range(8)]) for k in range(8) for s in (0, 1)]
    compare(whiten.whiten(vectors(spark, rows)).collect(), plain_whiten(rows))


def test_whiten_equal_variances(spark):
    """Equal variances have no axes of their own; each is still counted."""
    rows = [(2 * k + s, [(1.0 - 2 * s) * (2 if k < 5 else 1) if j == k else 0.0 for j in range(12)]) for k in range(12) for s in (0, 1)]
    got = whiten.whiten(vectors(spark, rows)).collect()
    assert all(abs(r.explained - 4 / 27) < 1e-9 and r.identity_error < 1e-9 for r in got) and len(got) == 96


def test_whiten_odd_rows(spark):
    assert whiten.whiten(vectors(spark, [])).count() == 0
    assert whiten.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [])])).count() == 0
    rows = [(None, [0.5, 1.0]), (7, [1.0, 0.25]), (7, [1.0, 0.25]), (8, [1.0, 2.0, 3.0])]
    got = whiten.whiten(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 2), (7, 1, 2), (7, 1, 2)]


# ------------------------------------------------------------- earlier operators

def test_lines_of_a_repeated_id(spark):
    """Rows of one id with different texts keep their own lines."""
    from quarry.llm import lines
    rows = [(0, "b\nb2\nb"), (1, "x\nb\nc\nd\ne"), (1, "x2\nb2\nc2\nd2\ne2"), (None, "p\nq"), (2, "p\nq"), (3, "A\nB\nA\nB\nu"), (3, "k\nl"), (3, "k\nl"), (4, "k\nl\nm")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, tag int, pos int")
    got = sorted((str(r.doc_id), r.text, r.kept_text) for r in lines.dedup_lines(frame).collect())
    kept = {"A\nB\nA\nB\nu": "A\nB\nu", "k\nl\nm": "m"}
    assert got == sorted((str(i), t, kept.get(t, t)) for i, t in rows)


def test_overlaps_of_few_words(spark):
    """A text of one word against an item of that word: a hit an alignment."""
    from quarry.llm import decontam
    docs_ = spark.createDataFrame([(1, "la " * 900), (2, "do " * 50 + "la " * 5), (3, "la do " * 300)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "la " * 200), (8, "la do " * 40)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_matched for r in decontam.overlaps(docs_, bench).collect()}
    assert got[1, 7] == 200 and got[3, 8] == 80 and (2, 7) not in got


def test_hosts_of_many_labels(spark):
    from quarry.llm import urlfilter
    rows = [(1, "http://" + "a." * 4000 + "net/es/x"), (2, "http://" + "." * 3000 + "com/"), (3, "http://a.b.c.d.www.example.com/en/")]
    frame = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(frame).collect()}
    assert got == {1: ("net/es/", "block"), 2: ("com/", "allow"), 3: ("www.example.com/en/", "allow")}


def test_capitals_count_in_the_whole_text():
    from quarry.llm import toxicity
    texts_ = ["quiet start, " + "LOUD ÉND " * 30, "Only The First Letters Of Words " * 5, "İ" * 50, "", "x", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    assert list(toxicity.Words(texts_).patterns[0]) == [True, False, False, False, False, True]
