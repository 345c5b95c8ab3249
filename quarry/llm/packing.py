"""Packing: documents in the order of a space-filling curve, cut every 1024 tokens.

A document's token ids are counted into a hashed vector, which a fixed random
matrix projects to three numbers; their place on a Hilbert curve is the sort
key.  Documents are range-sorted by that key and laid end to end, so a sequence
holds neighbours on the curve, and only the very last sequence can be short.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import held, pick, prepare, release, running_start, stage

LENGTH = 1024
DIMS, BITS, HASHED = 3, 10, 509
CACHE = 200_000  # pre-tokens whose ids a worker remembers, and as many that it met before those

# letters, numbers and the rest of Latin text, as the vocabulary's own pattern
# classes them; anything else goes to the tokenizer itself
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xffĀ-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile("[\t\n\x0b\x0c\r -~\xa1-\xffĀ-ſ‐-‧]*")
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Ids:
    """Token ids of texts: the ids that ``tokenizers`` gives for the file at
    ``path``, with the ids of words met before taken from memory.  When that is
    full it becomes the older half, from which words that come again are taken
    over, so that frequent words stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.full = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = special
        self.words = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        del spec, ranks
        release(all_=False)

    def _new(self, word: str) -> bytes:
        if len(word) > 200:  # the cost of merging grows faster than the word
            return np.array(self.full.encode(word, add_special_tokens=False).ids, self.type).tobytes()
        ids = self.known.get(word) or self.before.get(word) or array(self.type.char, self.words.encode_ordinary(word)).tobytes()
        if len(self.known) >= CACHE:
            self.known, self.before = {}, self.known
        self.known[word] = ids
        return ids

    def of(self, text: str) -> np.ndarray:
        if not _LATIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, self.type)
        known, new = self.known, self._new
        return np.frombuffer(b"".join([known.get(w) or new(w) for w in _PRE.findall(text)]), self.type)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


held(ids_of.cache_clear)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) below 2**bits."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, 0) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenise(path: str):
    flat = np.random.default_rng(7).normal(size=(HASHED, DIMS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_for = ids_of(path)
        for b in batches:
            blobs, counts = [], []
            vectors = np.zeros((len(b), HASHED))
            for i, text in enumerate(b["text"]):
                ids = np.append(ids_for.of(text), ids_for.type.type(0))
                blobs.append(ids.tobytes())
                counts.append(len(ids))
                vectors[i] = np.bincount(ids % HASHED, minlength=HASHED)
            vectors = np.sqrt(vectors)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            spot = (np.tanh(vectors @ flat / 2) + 1) / 2 * ((1 << BITS) - 1)
            yield pd.DataFrame({"row": b["row"], "doc_id": b["doc_id"], "place": hilbert(spot, BITS),
                                "n": np.array(counts, np.int64), "ids": blobs, "width": np.full(len(b), ids_for.type.itemsize, np.int32)})
        release(all_=False)
    return run


def _pieces(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, blob, width, first, n in zip(b["doc_id"], b["ids"], b["width"], b["start"], b["n"]):
                raw = np.frombuffer(blob, f"<u{width}").astype("<u4").tobytes()
                at = 0
                while at < n:
                    offset = (first + at) % length
                    size = min(length - offset, n - at)
                    out.append((doc, at, size, zlib.crc32(raw[4 * at:4 * (at + size)]), n, (first + at) // length, offset))
                    at += size
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32 (of its ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    ``tokenizer``: path of a ``tokenizers`` file that every worker can open.
    Every document ends with id 0; null and empty texts are that id alone.
    Copies have one key and are ordered by doc_id, then by their place in the
    input, so repeated rows and null ids are packed like any other.  Only the
    last sequence can be shorter than ``length``.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("row", F.monotonically_increasing_id())
    ids = stage(d.mapInPandas(_tokenise(tokenizer), "row long, doc_id long, place long, n long, ids binary, width int"), "ids")
    # the order is worked out without the ids
    starts = running_start(ids.select("place", "doc_id", "row", "n"), ["place", "doc_id", "row"], "n")
    return ids.drop("place").join(starts.select("row", "start"), "row").mapInPandas(
        _pieces(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


def stage_pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents kept."""
    return pack(docs, default_tokenizer())
