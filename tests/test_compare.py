"""Result-set comparison properties."""
import random

from pyspark.sql import functions as F

from quarry.operators import compare as C

SCHEMA = "example_id long, side string, pos long, a long, b double, c string"


def _verdicts(spark, rows, ids, ordered=False):
    df = spark.createDataFrame(rows, SCHEMA)
    keys = C.keyed(df, ["a", "b", "c"], keep=["pos"])
    ex = spark.createDataFrame([(i,) for i in ids], "example_id long")
    f = C.match_ordered if ordered else C.match_bag
    return {r.example_id: r.match for r in f(keys, ex).collect()}


def test_bag_semantics(spark):
    rows = [
        (1, "gold", 0, 1, 2.0, "x"), (1, "pred", 0, 1, 2.0000001, " x "),   # rounding + strip
        (2, "gold", 0, 1, 1.0, "y"), (2, "gold", 1, 1, 1.0, "y"), (2, "pred", 0, 1, 1.0, "y"),  # duplicates matter
        (3, "gold", 0, 1, None, "z"), (3, "pred", 0, 1, None, "z"),           # NULL equals NULL
        (4, "gold", 0, 1, 1.0, "w"),                                         # missing pred
    ]
    assert _verdicts(spark, rows, [1, 2, 3, 4, 5]) == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_bag_is_permutation_invariant(spark):
    rng = random.Random(7)
    gold = [(9, "gold", i, rng.randint(0, 5), float(rng.randint(0, 3)), "t") for i in range(40)]
    pred = [(9, "pred", i, r[3], r[4], r[5]) for i, r in enumerate(rng.sample(gold, len(gold)))]
    assert _verdicts(spark, gold + pred, [9]) == {9: True}
    assert _verdicts(spark, gold + pred, [9], ordered=True) == {9: False} or sorted(gold) == sorted(pred)


def test_ordered(spark):
    rows = [(1, "gold", 0, 1, 1.0, "a"), (1, "gold", 1, 2, 1.0, "b"),
            (1, "pred", 0, 1, 1.0, "a"), (1, "pred", 1, 2, 1.0, "b"),
            (2, "gold", 0, 1, 1.0, "a"), (2, "gold", 1, 2, 1.0, "b"),
            (2, "pred", 0, 2, 1.0, "b"), (2, "pred", 1, 1, 1.0, "a"),
            (3, "gold", 0, 1, 1.0, "a"), (3, "pred", 0, 1, 1.0, "a"), (3, "pred", 1, 1, 1.0, "a")]
    assert _verdicts(spark, rows, [1, 2, 3, 4], ordered=True) == {1: True, 2: False, 3: False, 4: True}


def test_int_equals_float(spark):
    a = spark.createDataFrame([(1,), (2,)], "v long")
    b = spark.createDataFrame([(2.0,), (1.0,)], "v double")
    assert C.frames_equal_bag(a, b).first().match is True
    c = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert C.frames_equal_bag(a, c).first().match is False


def test_cell_kinds(spark):
    """Numbers equal numbers of any type, never texts; NULL, NaN and the
    infinities equal themselves only; cells never run into each other."""
    schema = "f double, i long, b boolean, t string, u string"
    key = C.row_key(spark.createDataFrame([], schema), ["f", "i", "b", "t", "u"])

    def keys(*rows):
        return [r[0] for r in spark.createDataFrame(list(rows), schema).select(key).collect()]

    one = spark.createDataFrame([(1.0, 1, True, "1.0000", "1")], schema).select(
        *[C.cell_key(F.col(f.name), f.dataType) for f in spark.createDataFrame([], schema).schema.fields]).first()
    assert one[0] == one[1] == one[2] and len({one[0], one[3], one[4]}) == 3
    odd = keys(*[(x, None, None, None, None) for x in (None, float("nan"), float("inf"), float("-inf"), 1e35, 0.0, 0.12345)])
    assert len(set(odd)) == len(odd)
    same = keys(*[(x, None, None, None, None) for x in (-0.0, 0.0, -0.00001)])
    assert len(set(same)) == 1
    texts = keys((None, None, None, "a\u0001b", ""), (None, None, None, "a", "\u0001b"), (None, None, None, "\u2400", None),
                 (None, None, None, None, "\u2400"), (None, None, None, "a", "t1:b"), (None, None, None, "at1:", "b"))
    assert len(set(texts)) == len(texts)
