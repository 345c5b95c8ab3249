"""How often keys occur, counted where the keys are dealt to, shard by shard.

A batch of rows sends each shard of the key space the places of its keys there;
the shard sums them up and answers every batch with a few bits a key.  Shards
hold a fixed number of keys, so there are more of them as the input grows, and
nothing passes through the driver.  A place is a cell of the shard, of which
there are sixteen a key: a key may be taken for a repeated one (some 6 % are),
never the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.common import mix, tidy

KEYS = 1 << 22  # of a shard, about
CELLS = 16  # of a key
_SALT = np.uint64(0x9FB21C651E98DF25)
PLACES = "batch long, shard long, cells binary, times binary"
ANSWERS = "batch long, shard long, bits binary"


class Shards:
    def __init__(self, keys: float):
        """For about ``keys`` keys, repeated ones counted each time."""
        self.n = max(1, int(np.ceil(keys / KEYS)))
        self.log2 = int(np.ceil(np.log2(max(1 << 16, CELLS * keys / self.n))))

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Shard (upper half) and cell (lower half) of keys."""
        m = mix(h ^ _SALT)
        shard = ((m >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)
        return (shard << np.uint64(32)) | (m & np.uint64((1 << self.log2) - 1))

    def partial(self, batch: int, h: np.ndarray) -> pd.DataFrame:
        """What a batch sends: each place once, with how often it is met (255 at most)."""
        places, times = np.unique(self._places(h), return_counts=True)
        shard = places >> np.uint64(32)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(places) else np.zeros(0, np.int64)
        cells, counts = [], []
        times = np.minimum(times, 255).astype(np.uint8)
        for s, e in zip(cuts, [*cuts[1:], len(places)]):
            steps = np.diff(places[s:e].astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
            cells.append(steps.view(np.uint8).reshape(-1, 4).T.tobytes())  # upper bytes are mostly zeros: they compress
            counts.append(times[s:e].tobytes())
        return pd.DataFrame({"batch": np.full(len(cuts), batch, np.int64), "shard": shard[cuts].astype(np.int64), "cells": cells, "times": counts})

    def answers(self, partials: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
        """For each batch and shard a bit for each threshold and place, in the
        order of the places: whether the place's count reaches it."""
        size = 1 << self.log2

        def reply(held: list, count: np.ndarray) -> Iterator[pd.DataFrame]:
            """``count`` is all zeros before and after."""
            at = [np.cumsum(np.frombuffer(c, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64) for _, _, c, _ in held]
            for cells, (_, _, _, times) in zip(at, held):
                count[cells] = np.minimum(count[cells].astype(np.uint16) + np.frombuffer(times, np.uint8), 255)
            out, n = [], 0
            for cells, (batch, shard, _, _) in zip(at, held):
                c = count[cells]
                out.append((batch, shard, np.packbits(np.concatenate([c >= t for t in thresholds]), bitorder="little").tobytes()))
                n += len(cells)
                if n >= 1 << 20:
                    yield pd.DataFrame(out, columns=["batch", "shard", "bits"])
                    out, n = [], 0
            if out:
                yield pd.DataFrame(out, columns=["batch", "shard", "bits"])
            for cells in at:
                count[cells] = 0

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, count = [], None
            for b in batches:
                for row in zip(b["batch"], b["shard"], b["cells"], b["times"]):
                    if held and held[0][1] != row[1]:
                        yield from reply(held, count)
                        held = []
                    if count is None:
                        count = np.zeros(size, np.uint8)
                    held.append(row)
            if held:
                yield from reply(held, count)

        return partials.repartition("shard").sortWithinPartitions("shard").mapInPandas(tidy(run), ANSWERS)

    def flags(self, h: np.ndarray, answers: pd.DataFrame, thresholds: int) -> list[np.ndarray]:
        """For each threshold, whether the keys ``h`` of a batch may reach it."""
        places, back = np.unique(self._places(h), return_inverse=True)
        out = [np.zeros(len(places), bool) for _ in range(thresholds)]
        shard = (places >> np.uint64(32)).astype(np.int64)
        for s, bits in zip(answers["shard"], answers["bits"]):
            i, j = np.searchsorted(shard, [s, s + 1])
            told = np.unpackbits(np.frombuffer(bits, np.uint8), count=thresholds * (j - i), bitorder="little").astype(bool)
            for o, part in zip(out, told.reshape(thresholds, j - i)):
                o[i:j] = part
        return [o[back] for o in out]
