"""Whitening of vectors along their leading principal components, found by Jacobi-Davidson without a matrix.

Vectors become whole numbers (floor of 256 times each entry), so counts, sums and centring are exact. The fit list has each distinct
vector once; it is written as blocks of packed numbers, and every product of the covariance with a few directions is one pass over
the blocks: each task centres its vectors, multiplies, adds up, and hands on one row, and a second stage adds those of many tasks. The driver holds
arrays of the dimension times a few directions, nothing that grows with the rows.

Jacobi-Davidson: a subspace starts from random directions; Rayleigh-Ritz gives the leading pairs of it; for each pair that hasn't
converged the correction equation, projected off the pairs found and locked, is solved roughly by MINRES, all in step so that an
inner step is one pass for all of them; the corrections extend the subspace, which restarts from its leading pairs when it is full.
A pair is locked when its residual reaches double precision, TOLERANCE times the dimension times the largest eigenvalue. A further
pair is followed until it is known to be smaller than the last.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, and so are vectors shorter than the
longest, which lack entries. Entries beyond the range of a long become its ends. Rows with equal vectors, or a null or repeated
vec_id, each get their own results. Components whose eigenvalue is zero to double precision don't exist: equal vectors give no row,
an empty table too. deviation is null where it exceeds a long. Only vec_id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 4
#: Residuals are at most this many units of rounding, times the dimension and the largest eigenvalue.
TOLERANCE = 1.0
START, MOST, KEEP = 16, 48, 20
INNER, INNER_GAIN = 6, 0.1
OUTER = 200
BLOCK_BYTES = 1 << 20
GROUPS = 32
EPS = float(np.finfo(float).eps)
Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, rhs: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Approximate solutions of product(x) = rhs for a symmetric product, all columns in step; a column stops at gain times its first residual."""
    beta = np.linalg.norm(rhs, axis=0)
    goal, x = gain * beta, np.zeros_like(rhs)
    v_old, v = np.zeros_like(rhs), rhs / np.where(beta > 0, beta, 1)
    w_old, w, eta = np.zeros_like(rhs), np.zeros_like(rhs), beta.copy()
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    going = beta > 0
    for _ in range(steps):
        if not going.any():
            break
        q = product(v)
        alpha = np.sum(v * q, axis=0)
        q = q - alpha * v - beta * v_old * (np.abs(v_old).sum(axis=0) > 0)
        ahead = np.linalg.norm(q, axis=0)
        first = np.abs(v_old).sum(axis=0) == 0
        b = np.where(first, 0, beta)
        rho0, rho2, rho3 = c * alpha - c_old * s * b, s * alpha + c_old * c * b, s_old * b
        rho1 = np.hypot(rho0, ahead)
        safe = np.where(rho1 > 0, rho1, 1)
        c_old, s_old, c, s = c, s, rho0 / safe, ahead / safe
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / safe
        x = x + np.where(going, c * eta, 0) * w
        eta = -s * eta
        going = going & (rho1 > 0) & (ahead > 0) & (np.abs(eta) > goal)
        v_old, v, beta = v, q / np.where(ahead > 0, ahead, 1), ahead
    return x


def orthonormal(basis: np.ndarray, more: np.ndarray) -> np.ndarray:
    """What the columns of more add to an orthonormal basis, orthonormal; columns that add nothing go."""
    out = basis
    for t in more.T:
        size = np.linalg.norm(t)
        for _ in range(3):
            t = t - out @ (out.T @ t)
        left = np.linalg.norm(t)
        if size > 0 and left > 1e-10 * size and np.isfinite(left):
            t = t / left
            t = t - out @ (out.T @ t)
            out = np.column_stack([out, t / np.linalg.norm(t)])
    return out[:, basis.shape[1] :]


def leading(product: Product, dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns): the count largest of a symmetric product of dimension dim, by falling eigenvalue."""
    rng = np.random.default_rng(7)
    basis = orthonormal(np.zeros((dim, 0)), rng.standard_normal((dim, min(dim, START))))
    images = product(basis)
    want = min(dim, count)
    for _ in range(OUTER):
        rotated = basis.T @ images
        values, turn = np.linalg.eigh((rotated + rotated.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, residual = basis @ turn, images @ turn - (basis @ turn) * values
        size = np.linalg.norm(residual, axis=0)
        goal = TOLERANCE * EPS * dim * max(abs(values[0]), np.finfo(float).tiny)
        locked = size[:want] <= goal
        if basis.shape[1] == dim or bool(locked.all()) and (size[want] <= goal or values[want] + size[want] < values[want - 1]):
            return values[:want], ritz[:, :want]
        open_ = [*np.flatnonzero(~locked), want][: want + 1] if want < basis.shape[1] else [*np.flatnonzero(~locked)]
        near, theta = ritz[:, : want + 1], values[open_]

        def apart(t: np.ndarray) -> np.ndarray:
            return t - near @ (near.T @ t)  # noqa: B023

        corrections = minres(lambda t: apart(product(apart(t)) - t * theta), -apart(residual[:, open_]), INNER, INNER_GAIN)  # noqa: B023
        if basis.shape[1] + len(open_) > min(MOST, dim) and basis.shape[1] < dim and min(MOST, dim) < dim:
            basis, images = basis @ turn[:, :KEEP], images @ turn[:, :KEEP]
        fresh = orthonormal(basis, apart(corrections))
        if fresh.shape[1] == 0:  # nothing new: a random direction
            fresh = orthonormal(basis, rng.standard_normal((dim, 1)))
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, product(fresh)])
    raise RuntimeError("the residuals did not reach double precision")


@dataclass
class Fit:
    """Where the fit list's centre is: count, exact sums, a whole-number centre near the mean and what the mean has beyond it."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Whole-number rows less the mean, rounded once."""
        near = (x - self.centre).astype(float) if np.abs(x.astype(float)).max(initial=0) < 2**61 else x.astype(float) - self.centre.astype(float)
        return near - self.rest


@dataclass
class Whitening:
    fit: Fit
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ self.components / np.sqrt(self.values)


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256.0))


def usable(embeddings: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """Rows whose vectors have the full dimension and finite entries, with x, the vector in whole numbers; and the dimension."""
    v = F.col(vector_col)
    full = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = embeddings.filter(full)
    longest = rows.agg(F.max(F.size(v)).alias("dim"))
    dim = longest.first()["dim"] or 0  # one number
    return rows.filter(F.size(v) == dim).withColumn("x", whole(v)), dim


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """The distinct x of rows in blocks (data), each of whole vectors and at most about BLOCK_BYTES."""
    most = max(1, BLOCK_BYTES // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dim)
            for i in range(0, len(x), most):
                yield pa.RecordBatch.from_arrays([pa.array([x[i : i + most].astype("<i8").tobytes()], pa.binary())], ["data"])

    return written(rows.select("x").distinct().mapInArrow(run, "data binary"), "fit")


def summed(blocks: DataFrame, dim: int, values: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all vectors: values turns a block into size numbers. Each task adds up its blocks and hands on one row; GROUPS tasks add those up, and the driver the last few."""
    kind = "<i8" if values(np.zeros((1, dim), np.int64)).dtype == np.int64 else "<f8"

    def row(slot: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], ["slot", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _total(values(np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)) for batch in batches for data in batch.column(0))
        if total is not None:
            yield row(TaskContext.get().partitionId() % GROUPS, total)

    def join(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([row(group.column("slot")[0].as_py(), _total(np.frombuffer(part.as_buffer(), kind) for part in group.column("part")))])

    parts = blocks.mapInArrow(run, "slot int, part binary").groupBy("slot").applyInArrow(join, "slot int, part binary").collect()  # GROUPS rows at most
    total = _total(np.frombuffer(bytes(r["part"]), kind) for r in parts)
    return np.zeros(size, kind) if total is None else total


def _total(parts: Iterator[np.ndarray]) -> np.ndarray | None:
    total = None
    for part in parts:
        total = part if total is None else total + part
    return total


def fitted(blocks: DataFrame, dim: int) -> Fit | None:
    """Count and exact sums: high and low halves apart, so that neither overflows."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]).astype(np.int64)

    got = summed(blocks, dim, halves, 2 * dim + 1).tolist()
    n, sums = got[0], [(a << 32) + b for a, b in zip(got[1 : dim + 1], got[dim + 1 :], strict=True)]
    if n == 0:
        return None
    centre = [s // n for s in sums]
    return Fit(n, sums, np.array(centre, np.int64), np.array([(s - n * c) / n for s, c in zip(sums, centre, strict=True)]))


def whitening(rows: DataFrame, dim: int, count: int = COMPONENTS) -> Whitening | None:
    """The leading components of the distinct x of rows; None where there is no component."""
    blocks = packed(rows, dim) if dim else None
    fit = fitted(blocks, dim) if dim else None
    if fit is None:
        return None
    trace = float(summed(blocks, dim, lambda x: np.array([np.sum(fit.centred(x) ** 2)]), 1)[0]) / fit.n

    def product(u: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = fit.centred(x)
            return (y.T @ (y @ u)).ravel()

        return summed(blocks, dim, part, u.size).reshape(u.shape) / fit.n

    if not trace > 0:
        return None
    values, components = leading(product, dim, count)
    some = values > EPS * dim * values[0]
    found = Whitening(fit, components[:, some], values[some], trace)
    k = found.values.size
    mean = summed(blocks, dim, lambda x: found.of(x).sum(axis=0), k) / fit.n

    def square(x: np.ndarray) -> np.ndarray:
        w = found.of(x) - mean
        return (w.T @ w).ravel()

    found.identity_error = float(np.abs(summed(blocks, dim, square, k * k).reshape(k, k) / fit.n - np.eye(k)).max())
    return found


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Exact sums of squares of n times x less the sums; None beyond a long."""
    largest = fit.n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, map(float, fit.sums)))
    if largest**2 * x.shape[1] < 2**62:
        return (((fit.n * x - np.array(fit.sums, np.int64)) ** 2).sum(axis=1)).tolist()
    exact = (sum((fit.n * a - s) ** 2 for a, s in zip(row, fit.sums, strict=True)) for row in x.tolist())
    return [e if e < 1 << 63 else None for e in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component."""
    rows, dim = usable(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")), "vector")
    found = whitening(rows, dim, count)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    k = found.values.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = found.values / found.trace
        for batch in batches:
            x, m = matrix(batch.column(1), dim), batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.fit.n)), pa.array(deviations(x, found.fit), pa.int64()).take(each),
                pa.array(found.of(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)
