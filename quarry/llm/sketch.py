"""A count-min sketch that tasks build in parts.

Tasks send the cells they counted, block by block; blocks are summed where they
meet, and what comes back is one bit per cell and threshold.  A cell's count is
at least that of every key in it, so a key may be taken for a repeated one but
never the other way round.  The width follows the number of keys up to a fixed
bound; beyond it more keys pass, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.llm.common import mix, stage, tidy

MAX_LOG2 = 28  # cells of a row: a bit map of at most 32 MB
_SALT = 0x9FB21C651E98DF25
SCHEMA = "block int, cells binary"


class Sketch:
    def __init__(self, keys: float, depth: int, max_log2: int = MAX_LOG2):
        self.depth = depth
        self.log2 = int(min(max(16, np.ceil(np.log2(max(1.0, 8 * keys)))), max_log2))
        self.block = min(20, self.log2)

    def _cells(self, h: np.ndarray, row: int) -> np.ndarray:
        return mix(h ^ np.uint64(_SALT * (row + 1) % (1 << 64))) >> np.uint64(64 - self.log2)

    def partial(self, h: np.ndarray) -> pd.DataFrame:
        """Cells of the keys ``h``; a key counts as often as it is given."""
        blocks, blobs = [], []
        for row in range(self.depth):
            c = np.sort(self._cells(h, row))
            b = c >> np.uint64(self.block)
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(c) else []
            for s, e in zip(cuts, [*cuts[1:], len(c)]):
                steps = np.diff(c[s:e] & np.uint64((1 << self.block) - 1), prepend=np.uint64(0))
                small = len(steps) and int(steps.max()) < 1 << 16
                blocks.append((row << (self.log2 - self.block)) + int(b[s]))
                blobs.append((b"2" if small else b"4") + steps.astype("<u2" if small else "<u4").tobytes())
        return pd.DataFrame({"block": np.array(blocks, np.int32), "cells": blobs})

    def merge(self, partials: DataFrame, thresholds: tuple[int, ...] = (2,), staged: bool = False) -> list[np.ndarray]:
        """For each threshold one bit per cell (all rows, one after the other).
        With ``staged`` the driver reads them from shared files part by part and
        never holds them twice."""
        size = 1 << self.block

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, count = None, None
            done = lambda: pd.DataFrame({"block": [at], "bits": [b"".join(np.packbits(count >= t, bitorder="little").tobytes() for t in thresholds)]})
            for b in batches:
                for block, blob in zip(b["block"], b["cells"]):
                    if block != at:
                        if at is not None:
                            yield done()
                        at, count = block, np.zeros(size, np.uint8)
                    cells, times = np.unique(np.cumsum(np.frombuffer(blob[1:], f"<u{chr(blob[0])}"), dtype=np.int64), return_counts=True)
                    count[cells] = np.minimum(count[cells].astype(np.int64) + times, 255)
            if at is not None:
                yield done()

        n = (self.depth << (self.log2 - self.block))
        merged = (partials.repartition(min(n, 64), "block").sortWithinPartitions("block")
                  .mapInPandas(tidy(run), "block int, bits binary"))  # a fixed number of bytes
        rows = stage(merged, "sketch").toLocalIterator() if staged else merged.collect()
        out = [np.zeros((n, size // 8), np.uint8) for _ in thresholds]
        for r in rows:
            for o, bits in zip(out, np.frombuffer(r["bits"], np.uint8).reshape(len(thresholds), -1)):
                o[r["block"]] = bits
        return [o.ravel() for o in out]

    def reaches(self, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether the count of a key may reach the threshold of ``bits``."""
        out = np.ones(len(h), bool)
        for row in range(self.depth):
            c = self._cells(h, row) + np.uint64(row << self.log2)
            out &= (bits[(c >> np.uint64(3)).astype(np.int64)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out
