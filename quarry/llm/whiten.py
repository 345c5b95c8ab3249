"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows stay with the tasks in blocks.  A step sends a direction to
them: every task multiplies its rows with it (Xv), and the products with its
rows again (X'u), and only sums come back.  New left and right directions are
made orthogonal to all earlier ones, the right ones as vectors, the left ones
as the combinations of columns that they are.  The singular values of the
small bidiagonal matrix give deviations, its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import pick, prepare, stage

COMPONENTS = 4
GRID = 256
BLOCK = 4096  # rows
CLOSE = 1e-13  # of the largest singular value: a residual that small has converged
LOST = 1e-10  # of the largest singular value: a length that small is rounding


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (whole numbers) of the rows that take part."""
    v = pick(vectors, vec_id="long", embedding="array<double>").select("vec_id", F.col("embedding").alias("c"))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (v.where(F.col("c").isNotNull() & (F.size("c") > 0)).where(~bad)
            .select("vec_id", F.transform("c", lambda c: F.floor(c * GRID).cast("long")).alias("x")))


def _blocks(distinct: DataFrame, size: int) -> DataFrame:
    """The rows packed as matrices of whole numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), BLOCK):
                x = np.array(b["x"].iloc[k:k + BLOCK].tolist(), np.int64).reshape(-1, size)
                yield pd.DataFrame({"block": [x.tobytes()]})
    return distinct.mapInPandas(run, "block binary")


class Rows:
    """Distinct whole-number rows in blocks, with their count and sums."""

    def __init__(self, blocks: DataFrame, size: int):
        self.blocks, self.size = blocks, size
        self.mean = np.zeros(size)
        totals = self._totals(lambda x, _: np.r_[len(x), x.sum(axis=0)], "long")
        self.n, self.sums = int(totals[0]) if len(totals) else 0, [int(s) for s in totals[1:]]
        if self.n:
            self.mean = np.array([s / self.n for s in self.sums])

    def _totals(self, partial, kind: str = "double") -> np.ndarray:
        """Sum of ``partial(block, centred block)``, an array of one length, over all blocks."""
        size, mean = self.size, self.mean

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                for blob in b["block"]:
                    x = np.frombuffer(blob, np.int64).reshape(-1, size)
                    own = partial(x, x - mean)
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"at": np.arange(len(total), dtype=np.int32), "v": total})

        sums = self.blocks.mapInPandas(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v"))
        got = sorted((r["at"], r["v"]) for r in sums.collect())  # as many numbers as the array has
        return np.array([v for _, v in got], np.int64 if kind == "long" else np.float64)

    def products(self, left: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For u = Xv: X'u, and the products of u with X ``left`` and itself."""
        w = np.column_stack([left, v])

        def partial(_, x: np.ndarray) -> np.ndarray:
            u = x @ w
            return np.r_[x.T @ u[:, -1], u.T @ u[:, -1]]

        got = self._totals(partial)
        return got[:self.size], got[self.size:]

    def moments(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums and products of the rows projected on ``w``, and the sum of all squares."""
        k = w.shape[1]

        def partial(_, x: np.ndarray) -> np.ndarray:
            y = x @ w
            return np.r_[y.sum(axis=0), (y.T @ y).ravel(), (x * x).sum()]

        got = self._totals(partial)
        return got[:k], got[k:k + k * k].reshape(k, k), float(got[-1])


def _unit(x: np.ndarray, against: list[np.ndarray], rng: np.random.Generator | None = None) -> tuple[np.ndarray, float]:
    """``x`` made orthogonal to ``against``, twice, and its length then."""
    for _ in range(2):
        for q in against:
            x = x - q * (q @ x)
    size = float(np.linalg.norm(x))
    return (x / size if size else x), size


def bidiagonalise(rows: Rows, want: int, known: list[np.ndarray], floor: float = 0.0, seed: int = 0) -> list[tuple[float, np.ndarray]]:
    """The ``want`` largest singular values of the centred rows, on the space
    orthogonal to ``known``, with their right vectors; fewer if there are no
    more.  With ``floor``: stops as soon as none can reach it."""
    rng = np.random.default_rng(seed)
    d = rows.size
    v, room = _unit(rng.normal(size=d), known)
    right: list[np.ndarray] = []  # v of each step
    left = np.zeros((d, 0))  # u of each step is the centred rows times a column
    back: list[np.ndarray] = []  # X'u of each step
    alphas: list[float] = []
    betas: list[float] = []  # betas[k] ties u[k] to v[k + 1]
    top = 0.0
    while len(right) < d - len(known) and room > 1e-8:
        # u = Xv, less its parts along earlier u
        w, xu, length = v, None, 0.0
        for _ in range(2):
            xtu, dots = rows.products(left, w)
            along = dots[:-1]
            length = float(np.sqrt(max(dots[-1] - along @ along, 0.0)))
            xu = xtu - (np.column_stack(back) @ along if back else 0)
            w = w - left @ along
            if dots[-1] == 0 or length ** 2 > 0.5 * dots[-1]:
                break
        top = max(top, length, *alphas[-1:])
        right.append(v)
        if length <= LOST * top or not length:
            # the rows have nothing along v: it is a null direction of theirs
            alphas.append(0.0)
            back.append(np.zeros(d))
            left = np.column_stack([left, np.zeros(d)])
            xu = np.zeros(d)
        else:
            alphas.append(length)
            back.append(xu / length)
            left = np.column_stack([left, w / length])
            xu = back[-1]
        v, beta = _unit(xu - alphas[-1] * right[-1], known + right)
        if beta <= LOST * top:  # the space so far is closed under X'X: go on outside of it
            beta = 0.0
            v, room = _unit(rng.normal(size=d), known + right)
            v, again = _unit(v, known + right)
            room *= again
        betas.append(beta)
        b = np.diag(alphas) + np.diag(betas[:-1], 1)
        p, s, q = np.linalg.svd(b)
        loose = beta * np.abs(p[-1])  # what each singular pair lacks
        if beta and len(s) >= want and (loose[:want] <= CLOSE * s[0]).all():
            break
        if floor and beta and s[0] + loose[0] < floor and len(s) > 2 * want + 8:
            return []
    if not alphas:
        return []
    vectors = np.column_stack(right) @ q.T
    return [(float(s[i]), _unit(vectors[:, i], known)[0]) for i in range(min(want, len(s))) if s[i] > LOST * top]


def components(rows: Rows, want: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """Largest singular values and right vectors of the centred rows.  One
    starting vector meets equal singular values once only, so what was found is
    taken out and the rest searched again, until it holds nothing as large."""
    found = bidiagonalise(rows, want, [])
    seed = 1
    while found:
        least = found[want - 1][0] if len(found) >= want else 0.0
        if len(found) >= rows.size:
            break
        more = bidiagonalise(rows, 1, [v for _, v in found], floor=least * (1 - 1e-9), seed=seed)
        if not more or more[0][0] < max(least * (1 - 1e-9), LOST * found[0][0]):
            break
        found = sorted(found + more, key=lambda f: -f[0])
        seed += 1
    return found[:want]


def whiten(vectors: DataFrame, want: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error for every row that takes part and each of the ``want``
    components of the largest variance.

    ``vectors``: vec_id, embedding.  Rows take part unless the vector is null,
    empty, or holds null or non-finite entries; entries are counted in whole
    256ths, rounded down.  Vectors of another length than most rows have (of
    equally common lengths the greatest) take no part either.  The fit weighs
    each different vector once; repeated rows and null ids get rows of their
    own.  Components without variance are left out: fewer than ``want`` if the
    vectors span fewer dimensions, none for one vector or an empty table.  A
    deviation beyond 64 bits fails rather than wraps.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = stage(whole_vectors(vectors), "whole")
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    size = int(sizes[0]["d"])
    rows = rows.where(F.size("x") == size)
    fit = Rows(stage(_blocks(rows.select("x").distinct(), size), "blocks"), size)
    found = components(fit, want)
    if not found:
        return spark.createDataFrame([], out)
    n, mean, sums = fit.n, fit.mean, fit.sums
    basis = np.column_stack([v for _, v in found])
    variance = np.array([s * s / n for s, _ in found])
    scale = basis / np.sqrt(variance)
    first, second, squares = fit.moments(scale)
    error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(len(found))).max())
    explained = variance / (squares / n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(explained)
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["x"].tolist(), np.int64).reshape(-1, size)
            y = (x - mean) @ scale
            far = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
            gap = x * np.int64(n) - np.array(sums, np.int64) if far ** 2 * size < 1 << 63 else x.astype(object) * n - np.array(sums, object)
            dev = [int(g) for g in (gap * gap).sum(axis=1)]
            yield pd.DataFrame({"vec_id": b["vec_id"].astype("Int64").repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(b)),
                                "n": n, "deviation": np.repeat(np.array(dev, np.int64), k), "whitened": y.ravel(), "explained": np.tile(explained, len(b)), "identity_error": error})
    return rows.mapInPandas(run, out)


def op12_whiten(spark, sf_dir: str) -> DataFrame:
    """``embeddings`` on their four components of the largest variance."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
