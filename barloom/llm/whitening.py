"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

A vector becomes the long vector x = floor(256 * c). The fit list, each distinct x once, is a written table. Of its
covariance V only products V Q with a block Q of a few columns are needed: a pass over the fit list gives, per partition,
the sums of (x - S/n) ((x - S/n) Q), and Spark adds them up; the covariance itself is never formed.

One round: a Chebyshev polynomial of V (a three-term recurrence, one pass a degree) keeps what lies in [0, cut] within one and lets
what lies above grow; then QR and Rayleigh-Ritz. ``cut`` is the least Ritz value of the block. Rounds end when the residuals
|V q - e q| certify every component to ``TIGHT`` of the largest eigenvalue, or when, below ``LOOSE``, rounding keeps them from shrinking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

from .common import matrix, vectors

COMPONENTS = 4
#: Columns of the block besides the components, and degree of the polynomial.
GUARD, DEGREE = 28, 10
TIGHT, LOOSE, ROUNDS = 1e-14, 1e-11, 500
SCALE = 256
#: Bits and number of the limbs that exact sums are added in.
LIMB, LIMBS = 40, 5

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _passed(fit: DataFrame, dim: int, step: Callable[[np.ndarray], np.ndarray], size: int, exact: bool = False) -> np.ndarray:
    """The sum over the fit list of ``step``, which turns rows x into ``size`` numbers; exact: whole numbers, added in limbs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = step(matrix(batch.column(0), dim))
                total = part if total is None else total + part
        if total is None:
            return
        limbs = [[t >> LIMB * j & (1 << LIMB) - 1 if j < LIMBS - 1 else t >> LIMB * j for t in total.tolist()] for j in range(LIMBS)] if exact else [total]
        for j, limb in enumerate(limbs):
            yield pa.RecordBatch.from_arrays([pa.array(range(j * size, (j + 1) * size), pa.int32()),
                                              pa.array(limb, pa.int64() if exact else pa.float64())], ["i", "t"])

    parts = fit.select("x").mapInArrow(work, f"i int, t {'bigint' if exact else 'double'}")
    out = np.zeros(size, object if exact else float)
    for i, t in parts.groupBy("i").agg(F.sum(F.col("t").cast("decimal(38,0)") if exact else F.col("t"))).collect():  # size rows, by limb
        out[i % size] += int(t) << LIMB * (i // size) if exact else t
    return out


class Model:
    """n, S and trace of V (exact), and the eigenpairs of V by falling eigenvalue."""

    def __init__(self, fit: DataFrame, components: int, guard: int, degree: int):
        first = fit.agg(F.count("*"), F.max(F.size("x"))).first()
        self.n, self.dim = first[0], first[1] or 0
        self.values, self.vectors, self.error, self.rounds = np.zeros(0), np.zeros((self.dim, 0)), None, 0
        if not self.n:
            return
        dim = self.dim

        def sums(x: np.ndarray) -> np.ndarray:
            wide = x.astype(object) if np.abs(x.astype(float)).max() * len(x) ** 0.5 > 2.9e9 else x
            return np.concatenate((wide.sum(0), (wide * wide).sum(0))).astype(object)

        total = _passed(fit, dim, sums, 2 * dim, exact=True)
        self.sums = [int(t) for t in total[:dim]]
        self.trace = sum(self.n * int(b) - a * a for a, b in zip(self.sums, total[dim:])) / self.n ** 2
        self.mean = np.array([a // self.n + a % self.n / self.n for a in self.sums])
        if self.trace > 0:
            self._solve(fit, min(components, dim), min(components + guard, dim), degree)

    def _times(self, fit: DataFrame, q: np.ndarray) -> np.ndarray:
        mean, n = self.mean, self.n

        def product(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return (c.T @ (c @ q)).ravel()

        return _passed(fit, self.dim, product, q.size).reshape(q.shape) / n

    def _solve(self, fit: DataFrame, want: int, block: int, degree: int) -> None:
        q = np.linalg.qr(np.random.default_rng(0).normal(size=(self.dim, block)))[0]
        least, stalled = np.inf, 0
        while True:
            vq = self._times(fit, q)
            e, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
            e, turn = e[::-1], turn[:, ::-1]
            q, vq = q @ turn, vq @ turn
            worst = np.linalg.norm(vq - q * e, axis=0)[:want].max() / e[0]
            stalled = 0 if worst < least / 2 else stalled + 1
            least = min(least, worst)
            if worst <= TIGHT or (worst <= LOOSE and stalled > 1):
                break
            if self.rounds >= ROUNDS:
                raise RuntimeError(f"residual {worst:g} after {ROUNDS} rounds: the eigenvalues are too close for this block and degree")
            self.rounds += 1
            # Filter, scaled so that the largest eigenvalue stays at one.
            half = max(e[-1], 1e-3 * e[0]) / 2
            s = s1 = half / (half - e[0])
            old, now = q, (vq - half * q) * (s1 / half)
            for _ in range(degree - 1):
                s2 = 1 / (2 / s1 - s)
                old, now = now, 2 * s2 / half * (self._times(fit, now) - half * now) - s * s2 * old
                s = s2
            q = np.linalg.qr(now)[0]
        kept = e[:want] > self.dim * np.finfo(float).eps * e[0]
        self.values, self.vectors = e[:want][kept], q[:, :want][:, kept]

    def check(self, fit: DataFrame) -> float:
        """Largest entry, without sign, of the whitened fit list's covariance minus the identity."""
        mean, turn, k = self.mean, self.vectors / np.sqrt(self.values), len(self.values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ turn
            return np.concatenate((w.sum(0), (w.T @ w).ravel()))

        total = _passed(fit, self.dim, moments, k + k * k) / self.n
        return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a vector and component.

    Rows take no part whose vector is null, empty or holds null or non-finite entries, or has another length than most vectors
    (ties: the longer one). Repeated rows count once in the fit list and each has its rows in the result; a null vec_id stays null.
    Components whose eigenvalue is zero to double precision have no rows, so a fit list of one vector, like an empty table, gives
    none. Of equal eigenvalues any orthogonal vectors of their space are taken. A deviation beyond a long is null. Entries
    beyond a long after scaling take the nearest long. Columns besides vec_id and embedding are left out.
    """
    whole = vectors(rows).select("vec_id", F.expr(f"transform(v, c -> floor({SCALE} * cast(c AS double)))").alias("x"))
    fit = cut_lineage(whole.select("x").distinct())
    model = Model(fit, components, guard, degree)
    if not len(model.values):
        return whole.sparkSession.createDataFrame([], SCHEMA)
    error = model.check(fit)
    dim, n, sums, mean, k = model.dim, model.n, model.sums, model.mean, len(model.values)
    turn, explained = model.vectors / np.sqrt(model.values), model.values / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_sums = np.array(sums, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), dim)
            small = np.abs(n * x.astype(float) - whole_sums.astype(float)).max() < (9e18 / dim) ** 0.5
            d = n * x - np.array(sums, np.int64) if small else n * x.astype(object) - whole_sums
            deviation = [t if t < 1 << 63 else None for t in (d * d).sum(1).tolist()]
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, n), pa.int64()), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(work, SCHEMA)
