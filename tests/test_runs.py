"""Exact McNemar test and pairwise tables of runs."""
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarry.operators import report as R


def exact(b, c):
    n = b + c
    return min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(min(b, c) + 1)), 2 ** n)))


def test_mcnemar_is_exact(spark):
    pairs = [(10, 6), (0, 0), (0, 5), (1, 0), (3, 3), (299, 9), (1000, 1100), (2000, 2001), (7, 8), (8, 7), (15, 16), (16, 40), (1, 60)]
    df = spark.createDataFrame(pairs, "b long, c long").select("b", "c", R.mcnemar_p(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(exact(r.b, r.c), rel=1e-9)


def test_mcnemar_of_a_billion(spark):
    """The normal approximation is close there; no array grows with min(b, c)."""
    pairs = [(500_000_000 - d, 500_000_000 + d) for d in (1, 5_000, 30_000)]
    df = spark.createDataFrame(pairs, "b long, c long").select("b", "c", R.mcnemar_p(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(math.erfc((r.c - r.b - 1) / math.sqrt(2 * (r.b + r.c))), rel=1e-6)


def test_pairwise(spark):
    rows = [(i, "x", r, ok) for i in range(40) for r, ok in (("base", i % 2), ("r1", i % 3 == 0), ("r2", 1)) if not (r == "r2" and i == 7)]
    df = spark.createDataFrame([(i, c, r, bool(ok)) for i, c, r, ok in rows], "example_id long, class string, run string, exec_ok boolean")
    got = {(r.run_a, r.run_b): r for r in R.pairwise(df, ["base", "r1", "r2", "never"]).collect()}
    assert set(got) == {(a, b) for a in ("base", "r1", "r2") for b in ("base", "r1", "r2") if a != b}
    x = got["base", "r1"]
    wins = sum(1 for i in range(40) if i % 3 == 0 and not i % 2)
    losses = sum(1 for i in range(40) if i % 3 and i % 2)
    assert (x.n, x.wins, x.regressions, x.comparable) == (40, wins, losses, True) and x.p_value == round(exact(wins, losses), 6)
    assert got["base", "r2"].n == 39 and not got["base", "r2"].comparable
    assert got["r1", "base"].wins == losses
