"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors are put on a grid of whole numbers, each distinct vector once, so that counts, sums
and distances from the mean are exact. Tasks add up centred scatter; the d x d sum is
factored by Cholesky with pivoting, and the columns of the triangular factor are rotated
until they are orthogonal: their norms give the eigenvalues of the covariance, the columns
over their norms the components. Only statistics of d x d numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import saved

#: The grid: whole numbers of 1/64, shifted to be positive for usual embeddings.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and more have no place on the grid (their sums would not be exact).
LARGEST = float(1 << 40)
#: Most entries of a vector: the d x d scatter has to fit the driver.
MOST_DIMENSIONS = 4096


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L @ L.T, L of as many columns as the matrix
    has rank: each step takes the largest diagonal entry that is left."""
    rest, d = np.array(matrix, float), len(matrix)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        at = k + int(np.argmax(rest.diagonal()[k:]))
        if not rest[at, at] > floor:
            return factor[:, :k], order
        swap, back = [k, at], [at, k]
        rest[swap], factor[swap], order[swap] = rest[back], factor[back], order[back]
        rest[:, swap] = rest[:, back]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated pair by pair until all are orthogonal.

    A sweep meets every pair once, in rounds of disjoint pairs that are rotated together.
    """
    cols = np.array(factor, float).T.copy()
    r = len(cols)
    if r < 2:
        return cols.T
    ring = list(range(r)) + [-1] * (r % 2)
    tolerance = np.finfo(float).eps * np.sqrt(len(cols[0]))
    for _ in range(most_sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(a, b) for a, b in zip(ring[:half], ring[half:][::-1]) if a >= 0 and b >= 0]
            i, j = (np.array(x) for x in zip(*pairs))
            x, y = cols[i], cols[j]
            a, b, c = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(a * b)
            cosine = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, float(cosine.max()))
            turn = cosine > tolerance
            ratio = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1.0, ratio))
            t = np.where(turn, t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            cols[i], cols[j] = cos[:, None] * x - sin[:, None] * y, sin[:, None] * x + cos[:, None] * y
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= tolerance:
            break
    return cols.T


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as rows) by falling eigenvalue, of those above zero."""
    factor, order = pivoted_cholesky(covariance)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    rank = np.argsort(-norms, kind="stable")
    components = np.empty_like(rotated)
    components[order] = rotated
    return norms[rank] ** 2, (components[:, rank] / norms[rank]).T


@dataclass
class Whitening:
    """A fitted whitening: exact n and sums over the distinct vectors, the leading components."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def _offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: whole numbers, of 64 bits where they fit, else Python's."""
        y, sums = x - SHIFT, [s - self.n * SHIFT for s in self.sums]
        most = max(int(np.abs(y).max(initial=0)) * self.n, max(map(abs, sums), default=0))
        if most < 1 << 61:
            return y * np.int64(self.n) - np.array(sums, np.int64)
        return y.astype(object) * self.n - np.array(sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self._offsets(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x-S)^2, exactly; null where a long cannot hold it."""
        off = self._offsets(x)
        most = int(np.abs(off).max(initial=0))
        if off.dtype == object or most * most * max(off.shape[1], 1) >= 1 << 63:
            off = off.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (off * off).sum(1).tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)


def on_grid(embeddings: DataFrame, dimensions: int | None = None) -> DataFrame:
    """vec_id, x: rows whose vectors are whole, entries as long floor(64 * c) + 1000000.

    Left out: null vectors, vectors with null, non-finite or too large entries (2^40 and
    more), and those of another length than ``dimensions``, by default the commonest length
    (of equally common ones the greatest).
    """
    c = F.col("embedding").cast("array<double>")
    sound = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    rows = embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0) & sound)
    if dimensions is None:
        lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dimensions = lengths.d if lengths else 0
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} entries; at most {MOST_DIMENSIONS} can be whitened")
    grid = F.transform("c", lambda v: F.floor(v * SCALE) + F.lit(SHIFT))
    return rows.where(F.size("c") == dimensions).select("vec_id", grid.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold rows, each with the vectors of its column ``at`` as a matrix."""
    for batch in batches:
        if len(batch):
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.reshape(len(batch), -1)


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Fits on each distinct ``x`` of ``vectors`` once; None where there is no vector."""
    distinct = saved(vectors.select("x").distinct(), "whitening-fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _matrices(batches):
            y = x - SHIFT
            for k in range(0, len(y), 1 << 16):
                part = y[k : k + (1 << 16)].sum(0).astype(object)  # 2^16 entries below 2^46: exact
                total = part if total is None else total + part
            n += len(y)
        if n:
            at = list(range(len(total)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([n] * len(at), pa.int64()), pa.array([str(v) for v in total])], names=["i", "n", "s"]
            )

    rows = distinct.mapInArrow(sums, "i int, n long, s string")
    totals = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not totals:
        return None
    n = totals[0].n
    model = Whitening(n, [int(r.s) + n * SHIFT for r in totals], np.empty((0, len(totals))), np.empty(0), 0.0)

    def scatter_of(values) -> np.ndarray:
        """Sum over all distinct vectors of v v', v as ``values`` gives it: a d x d sum per
        task, rows of which are added up where they meet."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, x in _matrices(batches):
                v = values(x)
                total = v.T @ v if total is None else total + v.T @ v
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"]
                )

        parts = distinct.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
        summed = parts.groupBy("i", "j").agg(F.sum("v").alias("v"))
        found = summed.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")).orderBy("i")
        return np.array([[c.v for c in r.row] for r in found.toLocalIterator()])

    covariance = scatter_of(model.centred) / n
    model.trace = float(np.trace(covariance))
    values, axes = eigen(covariance)
    model.eigenvalues, model.components = values[:components], axes[:components]
    if len(model.eigenvalues):
        model.identity_error = float(np.abs(scatter_of(model.whitened) / n - np.eye(len(model.eigenvalues))).max())
    return model


def whiten(embeddings: DataFrame, components: int = 16, dimensions: int | None = None) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error per vector of
    ``embeddings`` (vec_id, embedding), whitened to its leading ``components``, fewer where the
    distinct vectors span fewer.

    Rows without a sound vector are left out (see ``on_grid``); null and repeated ids are kept
    as they are, repeated vectors count once in the fit. Where all vectors are equal the arrays
    are empty; an empty table gives no rows; other columns are not read.
    """
    vectors = on_grid(embeddings, dimensions)
    model = fit(vectors, components)
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    rows = vectors.select(F.col("vec_id").cast("long"), "x")
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (model.eigenvalues / model.trace).tolist() if model.trace else []
        for batch, x in _matrices(batches, at=1):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([model.n] * len(x), pa.int64()), pa.array(model.deviations(x), pa.int64()),
                    pa.array(model.whitened(x).tolist(), pa.list_(pa.float64())),
                    pa.array([share] * len(x), pa.list_(pa.float64())),
                    pa.array([model.identity_error] * len(x), pa.float64()),
                ],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def components_of(whitened: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    both = F.arrays_zip("whitened", "explained")
    return whitened.select("vec_id", "n", "deviation", "identity_error", F.posexplode(both).alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )
