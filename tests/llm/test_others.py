"""Archives, url rules, decontamination, toxicity, neighbours, packing, pipeline."""
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import ann, common, decontam, packing, toxicity, urlfilter, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, tmp_path):
    big = "ü" * 600
    rows = [(1, "http://a.com/x", big), (2, None, big), (3, "http://b.net/\r\nWARC/1.1", big + "!"), (4, "u", None), (5, "u", ""), (6, "u", "short"),
            (7, "u", "short"), (8, "http://a.com/y", big), (8, "http://a.com/y", big), (None, "n", "\r\n\r\nWARC/1.1\r\n" * 60)]
    path = str(tmp_path / "w")
    warc.write_pages(pages(spark, rows), path)
    assert warc.read_warc(spark, path).count() == len(rows)
    got = warc.read_warc(spark, path)
    back = {r.record_id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert back["urn:page:8"].decode() == big and back["urn:page:4"] == b"" and back["urn:page:"].decode().endswith("WARC/1.1\r\n")
    assert {(r.record_id, r.refers_to) for r in got.where("record_type = 'revisit'").collect()} == {("urn:page:1", "urn:page:8"), ("urn:page:2", "urn:page:8")}
    assert got.where("target_uri = 'http://a.com/y'").count() == 2
    heads = warc.read_warc(spark, path, payload=False)
    assert heads.where("payload is not null").count() == 0 and heads.where("payload_length >= 1200").count() == 5
    split = spark.read.format("warc").option("splitBytes", "300").load(path)
    assert sorted(r.record_id for r in split.collect()) == sorted(r.record_id for r in warc.read_warc(spark, path).collect())


def test_warc_of_others(spark, tmp_path):
    """Plain files and gzip members without a size field."""
    import gzip
    rec = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(rec % 1 + rec % 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(rec % 3) + gzip.compress(rec % 4))
    got = {r.record_id: bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got == {f"urn:x:{i}": b"hello" for i in (1, 2, 3, 4)}


def test_warc_empty(spark, tmp_path):
    warc.write_pages(pages(spark, []), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_url_rules(spark):
    rows = [(1, "http://WWW.Example.com/en/a?x", None), (2, "http://example.com/en/", None), (3, "http://example.com/fr/", None), (4, "x://a.net/es/1#t", None),
            (5, "http://net/fr", None), (6, None, None), (7, "no scheme", None), (8, "http://a.org/en/", None), (9, "http://examplexcom/en/", None), (9, "http:///x", None)]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.judge(pages(spark, rows)).collect())
    assert got == [(1, "www.example.com", "/en/a", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"),
                   (3, "example.com", "/fr/", "com/", "allow"), (4, "a.net", "/es/1", "net/es/", "block"), (5, "net", "/fr", "", "allow"), (6, "", "", "", "allow"),
                   (7, "", "", "", "allow"), (8, "a.org", "/en/", "", "allow"), (9, "", "/x", "", "allow"), (9, "examplexcom", "/en/", "", "allow")]
    assert urlfilter.judge(pages(spark, [])).count() == 0


def test_cascade_is_exact(spark):
    """Few bits force several levels; membership is exact on the universe."""
    r = np.random.default_rng(3)
    keys = r.integers(-2**62, 2**62, 3000)
    universe = spark.createDataFrame([(int(k),) for k in keys], "h long")
    listed = spark.createDataFrame([(int(k),) for k in keys[:900]], "h long")
    bits, urlfilter.BITS_PER_KEY = urlfilter.BITS_PER_KEY, 3
    try:
        c = urlfilter.build_cascade(spark, listed, universe)
    finally:
        urlfilter.BITS_PER_KEY = bits
    assert len(c.levels) > 2 and (c.listed(keys) == (np.arange(3000) < 900)).all()


def test_overlaps(spark):
    item = "The quick brown fox, jumps over the lazy dog while seven wizards brew a potent green elixir tonight"
    words = item.split()
    swapped = [w if i % 6 != 5 else "other" for i, w in enumerate(words)]
    rows = [(1, "before " * 9 + item.upper() + " after"), (2, "x " + " ".join(swapped)), (3, " ".join(words[:7])), (4, None), (5, ""), (1, item), (None, item),
            (6, "nothing of it " * 500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, seed int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_matched, r.doc_start) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(1, 7): (18, 18, 0), (2, 7): (18, 15, 1), (None, 7): (18, 18, 0)}
    assert decontam.overlaps(docs.limit(0), bench).count() == 0 and decontam.overlaps(docs, bench.limit(0)).count() == 0


def test_overlaps_partial_gapped_and_short(spark):
    """Part of a long item, words added or dropped, and items too short for a mask."""
    long, mid = [f"l{i}" for i in range(400)], [f"m{i}" for i in range(18)]
    rows = [(1, ["a"] * 30 + long[100:250] + ["b"] * 30), (2, mid[:9] + ["x"] + mid[9:]), (3, mid[:6] + ["x"] + mid[6:12] + ["y"] + mid[12:]),
            (4, ["z"] * 5 + mid[:8] + mid[9:]), (5, mid[:9] + ["far"] * 40 + mid[9:]), (6, ["c", "s0", "s1", "s2", "c"]), (7, ["s0", "x", "s1", "s2"]),
            (8, long[40:47] + ["q"] * 300 + long[300:308]), (9, ["one"]), (10, mid[:7] + ["x"] + mid[7:10] + ["y"] * 9)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(mid)), (3, "S0, s1 s2!"), (4, "One"), (5, "?!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_matched) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(1, 1): (400, 150), (2, 2): (18, 18), (3, 2): (18, 18), (4, 2): (18, 17), (5, 2): (18, 18), (6, 3): (3, 3), (9, 4): (1, 1), (10, 2): (18, 10)}


def test_overlaps_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"t{i}{k % (i + 9)}" for k in range(60))) for i in range(8)], "doc_id long, text string")
    bench = docs.selectExpr("doc_id as item_id", "text")
    want = sorted(decontam.overlaps(docs, bench).collect())
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(decontam.overlaps(docs, bench).collect()) == want and len(want) >= 8


def test_overlaps_of_a_large_benchmark(spark, monkeypatch):
    """Seeds are joined by shuffle without the words; ids of equal items each get their pairs, and so do repeated rows."""
    from pyspark.sql import functions as F
    r = random.Random(5)
    items = [[f"w{r.randrange(300)}" for _ in range(30)] for _ in range(12)] + [["la"] * 40]
    texts = [[f"o{r.randrange(9000)}" for _ in range(n)] + items[i % 13][:n] + items[i * 5 % 13][7:] for i, n in enumerate([25, 3000, 8, 40, 12] * 4)]
    rows = [(i % 15, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(texts[0])), (3, " ".join(texts[3])), (3, " ".join(texts[3]).upper()), (99, None), (98, "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = [(i, " ".join(t)) for i, t in enumerate(items)]
    bench = spark.createDataFrame(some + [(i + 50, t) for i, t in some[:6]] + [(None, some[1][1]), (8, some[2][1]), (7, None), (20, "La, la!")], "item_id long, text string")
    want = sorted(map(str, decontam.overlaps(docs, bench).collect()))
    alone = sorted(map(str, decontam.overlaps(docs, bench.where("item_id between 50 and 59")).collect()))
    assert len(want) > 40 and alone == [x for x in want if "item_id=5" in x and "item_id=5," not in x]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    far = decontam.overlaps(docs, bench)
    assert sorted(map(str, far.collect())) == want
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # rows of seeds, four a word, hold no array of words
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    passed = decontam.known(spark.range(60000).select("id", F.xxhash64("id").alias("h")), "h", keys).select("id").collect()
    assert {x.id for x in passed} >= set(range(3000)) and len(passed) < 4500
    monkeypatch.setattr(decontam, "MOST_BLOCKS", 2)  # a full map lets more through and loses none
    assert sorted(map(str, decontam.overlaps(docs, bench).collect())) == want


def test_toxicity(spark):
    r = random.Random(2)
    words = [a + b + c for a in "bdgklm" for b in "aeiou" for c in ("ra", "lin", "tos")]
    docs, labels = [(9000, None), (9001, "")], [(9000, 0), (9001, None), (None, 1)]
    for i in range(900):
        toxic = i % 6 == 0
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        if toxic:
            t.insert(r.randrange(len(t)), r.choice(["moron", "Pathetic!", "zwupffer" + r.choice(words), "zwupffen"]))
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, toxic int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(d, lab).collect()}
    assert len(got) == 902 and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    held = [i for i in range(900) if got[i].held_out]
    right = sum((got[i].score >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert got[9000].score < 0.7 and got[9001].score < 0.7
    assert toxicity.score(d.limit(0), lab).count() == 0
    assert toxicity.score(d, lab.limit(0)).count() == 902


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 8)).round(3)
    x[50:90] = x[0]  # a large group of copies
    rows = [(i, [float(c) for c in v], "k") for i, v in enumerate(x)]
    rows += [(500, None, "k"), (600, [0.0] * 8, "k"), (700, [1.0] * 7 + [None], "k"), (800, [1.0] * 7 + [float("nan")], "k"), (None, [1.0] * 8, "k"), (300, rows[300][1], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = {}
    for row in ann.nearest(df).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(got) == [0, 100, 200, 300]
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((v, i) for i, v in enumerate(d) if i != q)[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(f[2] - d[f[1]]) < 1e-12 for f in found)
        hit += len({i for _, i in want} & {f[1] for f in found})
    assert hit >= 36 and [f[1] for f in sorted(got[0])] == list(range(50, 60))
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id < 3")).count() == 2


def test_neighbours_recall(spark):
    """Far more vectors than a node or a walk remembers; two lengths that never meet."""
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 32)) + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(10_000 + 100 * i, [float(i + 1), 1.0]) for i in range(4)]
    got = {}
    for row in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    assert got[10_000] == {10_100, 10_200, 10_300}
    hit = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 300


def test_hilbert_is_a_curve():
    n = 8
    p = np.stack(np.meshgrid(*[np.arange(n)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert(p, 3)
    assert sorted(key) == list(range(n ** 3))
    walk = p[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    texts = [None, "", "plain words, 1234 ²½ they're   spaced \n\n out\t", "日本語 and œuvre “quoted” — \x1c\x85\xa0x", "a<|endoftext|>b", "ab " * 3000, "z" * 5000, "same", "same"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (7, "same", 0)], "doc_id long, text string, place int")
    got = packing.pack(docs, path).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in [*enumerate(texts), (None, "no id")]}
    at = {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in at.items():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end == packing.LENGTH or s == max(at)
    assert sum(r.length for r in got) == sum(len(ids[i]) for i in [*range(len(texts)), None, 7])
    assert packing.pack(docs.limit(0), path).count() == 0


def test_running_start(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as k", "id % 3 as n")
    got = {r.id: r.start for r in common.running_start(df, ["k", "id"], "n").collect()}
    at = 0
    for k, i in sorted((i % 7, i) for i in range(500)):
        assert got[i] == at
        at += i % 3


def test_pipeline(spark, tmp_path):
    """Every stage's decision shows, and clean documents come through whole."""
    r = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in ("ar", "el", "on", "ix") for c in ("am", "es", "ul", "op")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item, clean = text(30), [text(80) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(clean)]
    copy = clean[3].split()
    copy[7] = "changed"
    docs += [(100, " ".join(copy)), (101, text(20) + " " + item + " " + text(20)), (102, text(40) + " moron " + text(9)),
             (103, "first line here\nsecond line here\n" + text(30)), (104, "first line here\nsecond line here\n" + text(30)), (105, "first line here\nsecond line here")]
    docs += [(200 + i, text(30) + " moron " + text(20)) for i in range(30)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert packed == set(range(40)) | {103, 104}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = common.stage(step(spark, now, str(tmp_path)), "step")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r.doc_id: r.text for r in now.collect()}
    assert all(left[i] == t for i, t in enumerate(clean)) and "first line" in left[103] and "first line" not in left[104]


@pytest.mark.parametrize("key", ["op1_warc", "op3_url_filter", "op10_line_dedup", "op6_substring_dedup"])
def test_sql(spark, duck, key):
    from quarry.llm import queries
    from tests.conftest import SF

    df = queries.queries()[key](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(queries.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
