"""Whitening of vectors by an incremental eigendecomposition.

Each task keeps the count, mean and spectrum (eigenvalues and eigenvectors of
the scatter about the mean) of the vectors it has read. A vector is one centred
rank-one update: its place in the eigenbasis is deflated (weights that vanish,
eigenvalues that are equal), the roots of the secular equation between the
remaining eigenvalues are found by rational steps that keep a bracket, and the
weights are taken anew from the roots, so that the new eigenvectors stay
orthogonal. Two spectra combine by one such update for each eigenpair of the
second and one for the difference of the means; tasks' spectra, of a fixed size
each, combine in levels of ``FAN`` to one.

A last pass over the vectors refines that basis (Rayleigh-Ritz): with counts and
sums from exact integers, the centred vectors are projected on the basis, the
projections' products are summed, and the Ritz vectors of the sum are the
components to double precision. Another pass measures the covariance of the
whitened values against the identity.

An entry c counts as the long floor(64 * c) + 1000000 (64 * c between -2**50 and 2**50, or else the nearer of these).

Cases: vectors that are null or hold null or non-finite entries are dropped, and
so are vectors without an entry or of another length than most (the shortest of
equally frequent lengths); repeated rows and ids count each; components whose
eigenvalue is nothing beside the greatest (1e-12 of it) have no scale: their
whitened values and share are 0, and ``identity_error`` leaves them out; a
deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_batches, kept

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Scaled entries beyond this count as this.
LIMIT = 2**50
#: Spectra that one task combines.
FAN = 16
#: Eigenvalues up to this share of the greatest count as none.
NONE_BELOW = 1e-12
_EPS = np.finfo(np.float64).eps


@dataclass
class Spectrum:
    """Eigenvalues (ascending) and eigenvectors (columns) of the scatter of ``n`` vectors about ``mean``."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def raised(self, weight: float, x: np.ndarray) -> None:
        """The scatter plus ``weight`` times the product of ``x`` with itself."""
        self.values, self.vectors = rank_one(self.values, self.vectors, weight, x)

    def add(self, x: np.ndarray) -> None:
        """One more vector."""
        apart = x - self.mean
        self.raised(self.n / (self.n + 1), apart)
        self.n += 1
        self.mean = self.mean + apart / self.n

    def combine(self, other: Spectrum) -> None:
        """The vectors of ``other`` too."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.raised(float(value), vector)
        apart, n = other.mean - self.mean, self.n + other.n
        self.raised(self.n * other.n / n, apart)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 = sum of squares / (root - poles), as (pole number, distance from that pole).

    ``poles`` rise strictly and ``squares`` are positive: a root lies after each
    pole and before the next. It is measured from the nearer one. A step solves
    the equation of two poles that has the sum's value and slope on either side;
    a step out of the bracket halves it instead.
    """
    k = len(poles)
    after = np.append(poles[1:], poles[-1] + squares.sum())
    gaps = after - poles

    left = 1 + (squares / (poles[None, :] - poles[:, None] - (gaps / 2)[:, None])).sum(axis=1) >= 0
    number = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    origin = poles[number]
    last = np.arange(k) == k - 1
    near = left | last
    low, high = np.where(near, 0.0, -gaps / 2), np.where(near, gaps / 2, 0.0)
    low[-1], high[-1] = (0.0, gaps[-1] / 2) if left[-1] else (gaps[-1] / 2, gaps[-1])
    at = (low + high) / 2
    one, two, below = poles - origin, after - origin, np.tri(k)
    apart = poles[None, :] - origin[:, None]
    for _ in range(80):
        away = apart - at[:, None]
        part = squares / away
        slope = part / away
        value = 1 + part.sum(axis=1)
        low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
        size = value - 2 * np.einsum("ij,ij->i", part, below)
        done = (np.abs(value) <= 4 * _EPS * k * size) | (high - low <= 2 * _EPS * np.abs(at))
        if done.all():
            break
        # c + a / (one - at) + b / (two - at) with the slopes of both sides
        p, q = one - at, two - at
        under = np.einsum("ij,ij->i", slope, below)
        over = np.where(last, 0.0, np.maximum(slope.sum(axis=1) - under, 0))
        a, b = under * p * p, over * q * q
        c = value - under * p - over * q
        # step t: (c (p - t) (q - t) + a (q - t) + b (p - t) = 0
        half, free = c * (p + q) + a + b, c * p * q + a * q + b * p
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(half * half - 4 * c * free, 0))
            big = half + np.where(half >= 0, root, -root)
            steps = np.stack([2 * free / big, big / (2 * c)])
            new = at + steps
            inside = (new > low) & (new < high) & np.isfinite(new)
            step = np.where(inside[0], new[0], np.where(inside[1], new[1], (low + high) / 2))
        at = np.where(done, at, step)
    return number, at


def rank_one(values: np.ndarray, vectors: np.ndarray, weight: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``vectors diag(values) vectors' + weight x x'``."""
    z = vectors.T @ x
    norm = float(np.sqrt(z @ z))
    if weight <= 0 or norm == 0:
        return values, vectors
    z, rho = z / norm, weight * norm * norm
    d, q = values.copy(), vectors.copy()
    small = 8 * _EPS * max(abs(d[-1]), rho)
    # equal eigenvalues: turned into each other until one of them has the weight
    for i in np.flatnonzero(np.diff(d) <= small):
        r = float(np.hypot(z[i], z[i + 1]))
        if r == 0:
            continue
        c, s = z[i + 1] / r, z[i] / r
        q[:, [i, i + 1]] = np.stack([c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]], axis=1)
        z[i], z[i + 1] = 0.0, r
    live = rho * np.abs(z) > small
    if not live.any():
        return values, vectors
    poles, w = d[live], rho * z[live] ** 2
    number, at = secular_roots(poles, w)
    roots = poles[number] + at
    # root j less pole i, then the weights that have exactly these roots
    apart = (poles[number] - poles[:, None]) + at[None, :]
    if len(poles) > 1:
        between = poles[None, :] - poles[:, None]
        np.fill_diagonal(between, 1.0)
        ratio = apart / between
        np.fill_diagonal(ratio, np.diagonal(apart))
        w = np.abs(np.prod(ratio, axis=1))
    else:
        w = np.abs(apart[:, 0])
    turned = np.sqrt(w)[:, None] * np.sign(z[live])[:, None] / apart
    turned /= np.sqrt((turned * turned).sum(axis=0))
    d[live], q[:, live] = roots, q[:, live] @ turned
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


_STATE = "part long, n long, mean array<double>, vals array<double>, vecs array<double>, total array<long>"


def _state(part: int, spectrum: Spectrum, total: np.ndarray) -> pa.RecordBatch:
    lists = [spectrum.mean, spectrum.values, spectrum.vectors.ravel()]
    arrays = [pa.array([part]), pa.array([spectrum.n]), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in lists), pa.array([total.tolist()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "n", "mean", "vals", "vecs", "total"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def entries(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors' entries as whole numbers, less SHIFT."""
    return np.clip(np.floor(SCALE * _matrix(column, dim).astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def _tasks_spectra(dim: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectrum, total = Spectrum.empty(dim), np.zeros(dim, np.int64)
        for batch in batches:
            x = entries(batch.column("vector"), dim)
            total += x.sum(axis=0)
            for row in x.astype(np.float64):
                spectrum.add(row)
        if spectrum.n:
            yield _state(TaskContext.get().partitionId(), spectrum, total)

    return task


def _combined(dim: int):
    def task(key: tuple, states: pa.Table) -> pa.Table:
        spectrum, total = Spectrum.empty(dim), np.zeros(dim, np.int64)
        for row in states.sort_by("part").to_pylist():
            spectrum.combine(Spectrum(row["n"], np.array(row["mean"]), np.array(row["vals"]), np.array(row["vecs"]).reshape(dim, dim)))
            total += np.array(row["total"], np.int64)
        return pa.Table.from_batches([_state(key[0].as_py(), spectrum, total)])

    return task


def spectrum_of(vectors: DataFrame, dim: int) -> tuple[Spectrum, np.ndarray]:
    """The spectrum of all vectors (about their mean, less SHIFT) and the exact sums of their entries (less SHIFT)."""
    states = in_batches(vectors.select("vector"), _tasks_spectra(dim), _STATE)
    parts = vectors.rdd.getNumPartitions()
    while parts > 1:
        states, parts = states.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_combined(dim), _STATE), -(-parts // FAN)
    row = states.first()
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["vals"]), np.array(row["vecs"]).reshape(dim, dim)), np.array(row["total"], np.int64)


def _summed(vectors: DataFrame, dim: int, width: int, project: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the projections of all vectors and of their products with each other; a task sends one row, rows are added in levels."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, any_ = np.zeros(width), np.zeros((width, width)), False
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                y = project(entries(batch.column("vector").slice(lo, 4096), dim))
                total, products, any_ = total + y.sum(axis=0), products + y.T @ y, True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array([*products.tolist(), total.tolist()], pa.list_(pa.float64()))], names=["line", "vals"])

    lines = in_batches(vectors.select("vector"), task, "line long, vals array<double>")
    added = lines.select("line", F.posexplode("vals").alias("at", "v")).groupBy("line", "at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width + 1, width))
    for r in added:
        out[r["line"], r["at"]] = r["v"]
    return out[-1], out[:-1]


def fit_list(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector holds finite entries only, and one at least."""
    finite: Column = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(finite & (F.size(vector) > 0), F.lit(False)))


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = fit_list(vectors, vector).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = lengths["dim"]
    rows = kept(rows.where(F.size("vector") == dim))
    spectrum, total = spectrum_of(rows, dim)
    n, basis = spectrum.n, spectrum.vectors[:, ::-1]
    mean = np.array([int(t) // n + (int(t) % n) / n for t in total])
    _, products = _summed(rows, dim, dim, lambda x: (x - mean) @ basis)
    values, ritz = np.linalg.eigh((products + products.T) / (2 * n))
    values, axes = np.maximum(values[::-1], 0), basis @ ritz[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dim)] < 0, -1, 1)
    width = min(components, dim)
    real = values[:width] > NONE_BELOW * values[0]
    scaled = np.where(real, axes[:, :width] / np.sqrt(np.where(real, values[:width], 1)), 0.0)
    share = np.where(real, values[:width] / max(values.sum(), np.finfo(float).tiny), 0.0)
    sums, squares = _summed(rows, dim, width, lambda x: (x - mean) @ scaled)
    covariance = (squares / n - np.outer(sums / n, sums / n))[np.ix_(real, real)]
    error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = entries(part.column("vector"), dim)
                y = (x - mean) @ scaled
                most = n * int(np.abs(x).max()) + int(np.abs(total).max())
                apart = x * n - total if most * most * dim < 2**63 else x.astype(object) * n - total.astype(object)
                long = pa.array([v if v < 2**63 else None for v in (apart * apart).sum(axis=1).tolist()], pa.int64())
                at = pa.array(np.repeat(np.arange(len(x)), width))
                columns = [part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * width, n)), long.take(at), pa.array(y.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * width, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return in_batches(rows, task, schema)
