"""Embedding whitening from an incrementally updated eigendecomposition.

1. Counts and exact sums give the centre.
2. Every partition keeps a spectrum (eigenvalues and eigenvectors of the scatter it has seen) and applies centred rank-one updates to it: the new eigenvalues are the
   roots of a secular equation; components that the update does not touch, and equal eigenvalues, are deflated. A block of ``block`` rows is first
   reduced to the rows of its triangular factor, which have the same scatter, so that a block costs as many updates as there are dimensions.
3. Spectra are combined ``FAN`` at a time: the directions of one, scaled by the root of their eigenvalues, are rank-one updates of the other.
4. The last spectrum's directions are a basis for one distributed Rayleigh-Ritz step: the scatter projected on them is added up over all rows, and its
   eigenvectors turn the basis into the components.
5. A last pass over the whitened rows measures their covariance, and the rows are given out.

The driver holds one spectrum (dimensions x dimensions), tasks get it with their code; nothing else is collected.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors of another length than most have; there are as many components as
have an eigenvalue above rounding (relative ``RANK``), so copies of one vector alone give no rows; repeated rows and null keys stay rows; scaled entries are cut off at +-2^48;
a deviation beyond a long is null; an empty table has no rows. Input columns besides key and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable
from plumbline.llm.vectors import field, finite, matrix, scaled, usual_length

COMPONENTS = 8
SHIFT = 100_000
MOST = 2**48
BLOCK = 32  # rows of a block, in dimensions
FAN = 8
RANK = 1e-12
EPS = np.finfo(np.float64).eps


# Rank-one updates ----------------------------------------------------------------------------------------------------------------
def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (d_j - x) for strictly ascending ``d`` and ``z`` without zeros: the roots, and the matrix root_i - d_j.

    Root i lies between d_i and d_i+1, the last one within d_k and d_k + |z|^2. Each is sought as its distance from the nearer of the two, by steps that
    interpolate the equation by a function with both poles; a step that leaves the bracket halves it instead.
    """
    k, z2 = len(d), z * z
    gap = np.append(np.diff(d), z2.sum())
    middle = d + gap / 2
    f = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    right = np.append(f[:-1] < 0, False)  # the last root is told from d_k
    origin = np.where(right, np.arange(k) + 1, np.arange(k))
    delta = d - d[origin][:, None]
    low = np.where(right, -gap / 2, np.where(f > 0, 0, gap / 2))
    high = np.where(right, 0, np.where(f > 0, gap / 2, gap))
    low[-1], high[-1] = (0, gap[-1] / 2) if f[-1] > 0 else (gap[-1] / 2, gap[-1])
    mu = (low + high) / 2
    upper = np.arange(k)[None, :] > np.minimum(np.arange(k), k - 2)[:, None]  # poles above the root; of the last root, its own
    first, second = np.minimum(np.arange(k), max(k - 2, 0)), np.minimum(np.arange(k) + 1, k - 1)
    rows = np.arange(k)
    for _ in range(100):
        away = delta - mu[:, None]
        with np.errstate(all="ignore"):
            terms = z2 / away
            f = 1 + terms.sum(axis=1)
            slope = terms / away
            above = np.where(upper, slope, 0).sum(axis=1)
            below = slope.sum(axis=1) - above
            low, high = np.where(f < 0, mu, low), np.where(f < 0, high, mu)
            settled = (np.abs(f) <= 4 * EPS * k * (1 + np.abs(terms).sum(axis=1))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
            if settled.all():
                break
            p, q = away[rows, first], away[rows, second]
            a = (p + q) * f - p * q * (above + below)
            b = p * q * f
            c = f - p * below - q * above
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = (a[-1] + root[-1]) / (2 * c[-1]) if a[-1] >= 0 else 2 * b[-1] / (a[-1] - root[-1])
            new = mu + step
            inside = np.isfinite(new) & (new > low) & (new < high)
        mu = np.where(settled, mu, np.where(inside, new, (low + high) / 2))
    return d[origin] + mu, mu[:, None] - delta


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors' + x x'``; ``values`` ascend."""
    z = vectors.T @ x
    norm = np.sqrt(z @ z)
    if not norm:
        return values, vectors
    tol = 8 * EPS * max(float(np.abs(values).max()), norm * norm)
    live = np.abs(z) * norm > tol
    vectors = vectors.copy()
    kept = np.flatnonzero(live).tolist()
    if not kept:
        return values, vectors
    # Of two eigenvalues that are equal but for rounding, a rotation gives one all of the update.
    last, solved = kept[0], []
    for j in kept[1:]:
        r = np.hypot(z[last], z[j])
        c, s = z[j] / r, z[last] / r
        if abs((values[j] - values[last]) * c * s) <= tol:
            z[j], z[last] = r, 0.0
            vectors[:, last], vectors[:, j] = c * vectors[:, last] - s * vectors[:, j], s * vectors[:, last] + c * vectors[:, j]
        else:
            solved.append(last)
        last = j
    solved.append(last)
    d = values[solved]
    if len(solved) == 1:
        values = values.copy()
        values[solved] = d + z[solved] ** 2
    else:
        roots, away = secular_roots(d, z[solved])
        # The z that has exactly these roots: with it the vectors are orthogonal to rounding.
        apart = d[:, None] - d[None, :]
        np.fill_diagonal(apart, 1.0)
        exact = np.sqrt(np.abs(np.prod(away / apart, axis=0))) * np.sign(z[solved])
        turn = exact / away
        turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
        vectors[:, solved] = vectors[:, solved] @ turn.T
        values = values.copy()
        values[solved] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Ascending eigenvalues and the eigenvectors (columns) of a scatter."""

    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(np.zeros(dims), np.eye(dims))

    def add(self, rows: np.ndarray) -> None:
        for x in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, x)

    def absorb(self, other: Spectrum) -> None:
        self.add((other.vectors * np.sqrt(np.maximum(other.values, 0))).T[other.values > 0])

    def pack(self) -> bytes:
        return np.vstack([self.values, self.vectors]).tobytes()

    @staticmethod
    def unpack(raw: bytes, dims: int) -> Spectrum:
        both = np.frombuffer(raw, np.float64).reshape(dims + 1, dims)
        return Spectrum(both[0].copy(), both[1:].copy())


# Passes --------------------------------------------------------------------------------------------------------------------------
def whole_numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return scaled(matrix(field(batch, "vector"), dims), MOST - SHIFT) + SHIFT


def _totals(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):  # 2^13 numbers of 2^48 fit a long
                x = whole_numbers(batch.slice(a, 8192), dims)
                total = [t + s for t, s in zip(total, x.sum(axis=0).tolist())]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "total": pa.array([str(t) for t in total]), "n": pa.array([n] * dims, pa.int64())})

    return run


def totals(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    parts = rows.mapInArrow(_totals(dims), "dim int, total string, n long")
    sums = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    return sums[0].n, [int(r.total) for r in sums]


def _spectra(centre: np.ndarray, block: int):
    dims = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, held, size = Spectrum.empty(dims), [], 0

        def give_in() -> None:
            rows = np.concatenate(held)
            mine.add(np.linalg.qr(rows, mode="r") if len(rows) > dims else rows)
            held.clear()

        seen = False
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                held.append(whole_numbers(batch.slice(a, block), dims) - centre)
                size += len(held[-1])
                seen = True
                if size >= block:
                    give_in()
                    size = 0
        if held:
            give_in()
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "spectrum": pa.array([mine.pack()], pa.binary())})

    return run


def _absorb(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one group follow each other."""
        part, mine = None, None
        for batch in batches:
            for p, raw in zip(field(batch, "part").to_pylist(), field(batch, "spectrum").to_pylist()):
                if p != part:
                    if mine is not None:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "spectrum": pa.array([mine.pack()], pa.binary())})
                    part, mine = p, Spectrum.unpack(raw, dims)
                else:
                    mine.absorb(Spectrum.unpack(raw, dims))
        if mine is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "spectrum": pa.array([mine.pack()], pa.binary())})

    return run


def combined(spectra: DataFrame, dims: int, fan: int = FAN) -> Spectrum:
    """One spectrum of all: ``fan`` neighbours at a time. ``spectra``: part, spectrum."""
    kind = "part int, spectrum binary"
    while (n := spectra.count()) > 1:
        near = spectra.withColumn("part", F.floor(F.col("part") / fan).cast("int")).repartition(-(-n // fan), "part").sortWithinPartitions("part")
        spectra = durable(near.mapInArrow(_absorb(dims), kind))
    return Spectrum.unpack(spectra.first().spectrum, dims)


def _projected(centre: np.ndarray, basis: np.ndarray):
    """The scatter of centred rows on ``basis``, a row of the matrix in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = basis.shape[1]
        total, seen = np.zeros((m, m)), False
        for batch in batches:
            y = (whole_numbers(batch, len(centre)) - centre) @ basis
            total += y.T @ y
            seen = True
        if seen:
            i, j = np.triu_indices(m)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "value": pa.array(total[i, j])})

    return run


def scatter_on(rows: DataFrame, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum over all rows of the projections' outer products."""
    parts = rows.mapInArrow(_projected(centre, basis), "i int, j int, value double")
    out = np.zeros((basis.shape[1],) * 2)
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # half a matrix
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


@dataclass
class Whitening:
    """What a fit knows: rows, exact sums, components (columns) by falling eigenvalue, eigenvalues and their sum over all dimensions."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def transform(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS, block: int = BLOCK, fan: int = FAN) -> Whitening:
    """``rows``: key, vector, all of ``dims`` finite entries; at least one row."""
    n, sums = totals(rows, dims)
    centre = np.array([s / n for s in sums])
    spectra = durable(rows.select("vector").mapInArrow(_spectra(centre, block * max(dims, 1)), "part int, spectrum binary"))
    basis, _ = np.linalg.qr(combined(spectra, dims, fan).vectors[:, ::-1])
    ritz = scatter_on(rows.select("vector"), centre, basis) / n
    values, turn = np.linalg.eigh(ritz)
    values, turn = values[::-1], turn[:, ::-1]
    keep = min(components, int((values > RANK * max(float(values[0]), 0)).sum())) if dims else 0
    axes = basis @ turn[:, :keep]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(keep)])  # the largest entry of a component is positive
    return Whitening(n, sums, axes, values[:keep].copy(), float(np.trace(ritz)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    total = np.array([float(s) for s in sums])
    rough = ((n * x.astype(np.float64) - total) ** 2).sum(axis=1)
    fits = n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, sums), default=0) < 2**62
    if fits and float(rough.max(initial=0)) < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def _whitened(w: Whitening, identity_error: float):
    centre, turn, k = w.centre, w.transform, len(w.values)
    explained = w.values / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch, len(centre))
            rows, n = len(x), len(x) * k
            keys = field(batch, "key").take(pa.array(np.repeat(np.arange(rows), k)))
            apart = pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(n, w.n, np.int64)), apart,
                                              pa.array(((x - centre) @ turn).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(n, identity_error))],
                                             names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error: a row for each vector that takes part and each component."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(finite(F.col("vector")))
    kind = f"key {rows.schema['key'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = usual_length(rows, "vector")
    if not dims:
        return table.sparkSession.createDataFrame([], kind).withColumnRenamed("key", key)
    rows = rows.filter(F.size("vector") == dims)
    w = fit(rows, dims, components, block, fan)
    if not len(w.values):
        return table.sparkSession.createDataFrame([], kind).withColumnRenamed("key", key)
    off = scatter_on(rows.select("vector"), w.centre, w.transform) / w.n - np.eye(len(w.values))
    return rows.mapInArrow(_whitened(w, float(np.abs(off).max())), kind).withColumnRenamed("key", key)
