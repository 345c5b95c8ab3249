"""Repeated words, bytes and lines, and near copies, against brute force."""
import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from quarry.llm import jaccard, lines, substring, suffix  # noqa: E402

SCHEMA = "doc_id long, text string, anchor string, name long, h1 long, n long, component long"


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, shared = text(400), text(70)
    edited = base.split()
    edited[200] = "changed"
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  two\n"), (5, base), (6, base), (7, " ".join(edited)), (8, base.replace(" ", "\n"))]
    rows += [(9 + i, text(20) + " " + shared + " " + text(15)) for i in range(6)]
    rows += [(20, "a " * 300), (21, "a " * 90), (22, "ü" * 200), (23, "ü" * 120), (24, "x\ny\nx\ny\nx\ny\n\nz"), (25, "q\nx\ny\n\n z\nx"),
             (26, shared.upper()), (27, text(5000) + " " + shared), (28, "line one\nline two\nline three"), (29, "line two\nline three")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def test_substring(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring.remove_repeats(frame(spark, corpus())).collect()}
    assert got == brute.substring(corpus())


@pytest.mark.parametrize("hot", [1, 2048])
def test_suffix(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.remove_repeats(frame(spark, corpus())).collect()}
    assert got == brute.suffix(corpus())


def test_suffix_array_of_one_block():
    import numpy as np
    texts = [b"abcabcabc", b"xabcab", b"abcabc"]
    hits = suffix.later_windows(texts, np.array([1, 2, 3]), 5)
    assert [list(h) for h in hits] == [[], [1], [0, 1]]


@pytest.mark.parametrize("leaders", [0, 3])
def test_jaccard(spark, monkeypatch, leaders):
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_sets(frame(spark, corpus())).collect()}
    assert got == brute.jaccard(corpus())


def test_jaccard_chain(spark):
    """Neighbours in a chain link, its ends do not: one component all the same."""
    w = [f"c{i}" for i in range(140)]
    rows = [(k, " ".join(w[4 * k:4 * k + 60])) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_sets(frame(spark, rows)).collect()}
    assert got == brute.jaccard(rows) and {c for _, c in got.values()} == {0}


def test_jaccard_without_fitting_leaders(spark):
    """Two sets meet only in lists whose leader is too large for either."""
    w, z = [f"w{i}" for i in range(9)], [f"z{i}" for i in range(4)]
    rows = [(1, " ".join(w[:8] + z)), (2, " ".join(w[:8])), (3, " ".join(w)), (4, " ".join(w[4:8] + z))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_sets(frame(spark, rows)).collect()}
    assert got == brute.jaccard(rows) == {1: (8, 1), 2: (4, 2), 3: (5, 2), 4: (4, 4)}


def test_jaccard_near_the_threshold(spark):
    """Edited copies of a few texts, longer and shorter, on both sides of the threshold."""
    r = random.Random(11)
    rows = []
    for k in range(90):
        w = [f"b{k % 3}_{i}" for i in range(r.choice([60, 75, 80]))]
        for at in r.sample(range(len(w)), r.randint(0, 4)):
            w[at] = f"e{r.randint(0, 5)}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join_sets(frame(spark, rows)).collect()}
    assert got == brute.jaccard(rows)


def test_lines(spark):
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in lines.dedup_lines(frame(spark, corpus())).collect()}
    assert got == brute.lines(corpus())
    row = lines.dedup_lines(frame(spark, corpus())).where("doc_id = 8").first()
    assert row.n_lines == 400 and row.name == 1


def test_lines_of_many_words(spark):
    """The pipeline stage deletes a repeated line by its words; shorter single lines stay."""
    text = lambda n: " ".join(f"v{i}" for i in range(n))
    rows = [(1, text(51)), (2, text(51)), (3, text(50)), (4, text(50)), (5, "own\n" + text(51) + "\nend"), (6, "own"), (7, text(60) + "\n" + text(60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.stage_line_dedup(spark, docs, "").collect()}
    want = {1: text(51), 3: text(50), 4: text(50), 5: "own\nend", 6: "own", 7: text(60)}
    assert got == {i: (t, len(t)) for i, t in want.items()}


@pytest.mark.parametrize("run", [substring.remove_repeats, suffix.remove_repeats, jaccard.join_sets, lines.dedup_lines])
def test_odd_rows(spark, run):
    """Empty tables give none; null ids and repeated rows stay and lose nothing to themselves."""
    assert run(frame(spark, [])).count() == 0
    text = " ".join(f"word{i}" for i in range(80))
    out = run(frame(spark, [(None, text), (1, text), (1, text)])).collect()
    assert all(r.n_removed == 0 for r in out if "n_removed" in r and run is not lines.dedup_lines)
    assert {r.doc_id for r in out} >= {1}
