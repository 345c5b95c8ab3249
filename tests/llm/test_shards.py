"""Counts by shards against plain counts."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("quarry.llm")
from quarry.llm import shards  # noqa: E402
from quarry.llm.common import prepare  # noqa: E402


def test_counts_by_shards(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(shards, "KEYS", 4000)  # several shards
    rng = np.random.default_rng(5)
    batches = [np.r_[rng.integers(0, 1 << 63, 1500), rng.integers(0, 400, 100), np.full(300, 7)].astype(np.uint64) for _ in range(8)]
    batches.append(np.zeros(0, np.uint64))
    sent = shards.Shards(sum(map(len, batches)))
    assert sent.n > 1
    parts = spark.createDataFrame(pd.concat([sent.partial(i, h) for i, h in enumerate(batches)]), shards.PLACES)
    told = sent.answers(parts, (2, 100)).toPandas()
    times = Counter(int(k) for h in batches for k in h)
    wrong = 0
    for i, h in enumerate(batches):
        two, many = sent.flags(h, told[told.batch == i], 2)
        for k, t, m in zip(h, two, many):
            assert t or times[int(k)] < 2  # none is lost
            assert m or times[int(k)] < 100
            wrong += bool(t) and times[int(k)] < 2
    assert wrong < 0.15 * sum(map(len, batches))
