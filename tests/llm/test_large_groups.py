"""Groups of many different members, and more words than a worker remembers."""
import hashlib
import random

import pytest

pytest.importorskip("quarry.llm")

import brute  # noqa: E402

from quarry.llm import jaccard, packing, suffix  # noqa: E402


def test_chunks_of_a_crowded_anchor_are_cut_not_dealt_by_window(spark, monkeypatch):
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    common, phrase = some(20), some(90)
    # the phrase stands in the same or another surrounding, a short common string in many
    rows = [(i, some(60) + common + some(60) + (phrase + some(40) if i % 5 == 0 else "")) for i in range(60)]
    rows += [(60 + i, rows[i][1][30:130]) for i in range(20)]
    made = {}
    stage = suffix.stage

    def counted(df, name, **k):
        out = stage(df, name, **k)
        made[name] = out.count()
        return out

    monkeypatch.setattr(suffix, "stage", counted)
    monkeypatch.setattr(suffix, "HOT", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix.remove_repeats(docs).collect()}
    assert got == brute.suffix(rows)
    assert made["anchors"] and made["pieces"]  # a row for some windows each, not for one
    # what is found goes by runs of windows
    assert made["windows"] < sum(x[1] for x in got.values()) / 10


def test_pieces_of_a_crowded_anchor_are_cut_again_and_go_as_one(spark, monkeypatch):
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    phrase = some(200)
    rows = [(i, some(70) + phrase[:200 - i % 7] + some(70)) for i in range(120)]
    made = {}
    stage = suffix.stage

    def counted(df, name, **k):
        out = stage(df, name, **k)
        made[name] = out.count()
        return out

    monkeypatch.setattr(suffix, "stage", counted)
    monkeypatch.setattr(suffix, "HOT", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix.remove_repeats(docs).collect()}
    assert got == brute.suffix(rows)
    assert made["windows"] < 1500  # 2,628 when a second anchor was the last


def test_words_that_come_again_stay_remembered(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    ids = packing.Ids(packing.default_tokenizer())
    asked, plain = [], ids.words.encode_ordinary

    class Words:
        def encode_ordinary(self, word):
            asked.append(word)
            return plain(word)

    ids.words = Words()
    texts = [f" the cat{'abcdefghijklmnopqrst'[i]} sat" for i in range(20)] + [" the" * 9, ""]
    for t in texts:
        assert list(ids.of(t)) == ids.full.encode(t, add_special_tokens=False).ids
    assert asked.count(" the") == asked.count(" sat") == 1 and len(ids.known) <= 3 and len(ids.before) <= 3


def test_a_group_of_copies_that_hardly_link_makes_few_pairs(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in r.sample(range(100), 2):
            words[at] = f"x{r.randrange(3)}"
        rows.append((i, " ".join(words)))
    made, plain = [], jaccard._open_pairs

    def counted(lists, percent):
        out = plain(lists, percent)
        made.append((out.count(), lists.count()))
        return out

    monkeypatch.setattr(jaccard, "_open_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join_sets(docs).collect()}
    assert got == brute.jaccard(rows)
    assert len({c for _, c in got.values()}) > 5  # many members are linked with nothing
    assert sum(m for m, _ in made) < sum(n for _, n in made)  # fewer pairs than entries of the lists
