"""Words of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quarry.llm.common import span_hashes

SLICE = 2 << 20  # bytes of text worked on at once; a longer text is a slice alone


def slices(docs, texts, most: int = SLICE) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of (ids, UTF-8 texts) of about ``most`` bytes."""
    ids, blobs, size = [], [], 0
    for d, t in zip(docs, texts):
        b = b"" if t is None else t.encode("utf-8", "replace") if isinstance(t, str) else bytes(t)
        if ids and size + len(b) > most:
            yield ids, blobs
            ids, blobs, size = [], [], 0
        ids.append(d)
        blobs.append(b)
        size += len(b)
    if ids:
        yield ids, blobs


class WordArrays:
    """Words between ASCII white space: ``hash`` of each, ``doc`` (index of its
    text), ``first`` (index of each text's first word, one more at the end)."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]  # bytes.split() cuts at \x20 and \x09-\x0D
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        a = np.frombuffer(b" ".join(b" ".join(w) for w in self.words if w) + b" ", np.uint8)
        end = np.flatnonzero(a == 32)
        start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
        if not self.first[-1]:
            start, end = start[:0], end[:0]
        self.hash = span_hashes(a, start, end)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """Indices of words at which a window of ``size`` words of one text starts."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1:])
