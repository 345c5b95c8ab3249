"""Driver contract: entry, queries and oracles; every oracle matches at sf0.001."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from tests.conftest import SF  # noqa: E402


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["nation", "category", "revenue", "customers", "pct", "rnk"]
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_oracle_matches(spark, duck, key):
    df = E.queries()[key](spark, SF)
    cols = df.columns
    a = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [c[0] for c in cur.description]
    assert sorted(dcols) == sorted(cols)
    idx = [dcols.index(c) for c in sorted(cols)]
    b = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert a == b
