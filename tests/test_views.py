"""The derived views must be the same rows in Spark and in DuckDB."""
import math

import pytest

from quarry.plans.views import VIEWS, view, with_views
from tests.conftest import SF


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_view_same_in_both_engines(spark, duck, name):
    df = view(spark, SF, name)
    a = _norm(tuple(r) for r in df.collect())
    cur = duck.execute(with_views(f"SELECT * FROM {name}"))
    b = _norm(cur.fetchall())
    assert [c[0] for c in cur.description] == df.columns
    assert len(a) == len(b)
    assert a == b
