"""Whitening of vectors by their leading principal components.

Components are quantised to whole numbers x, so that sums are exact. Tasks sum them, then, centred
by the exact mean, their products; partial matrices are added row by row in a fixed order. The
covariance, at most dimensions by dimensions, is reduced on the driver to a tridiagonal matrix by
Householder reflections. Its leading eigenvalues are found by bisection over Sturm counts, their
vectors by inverse iteration, orthogonalised anew inside clusters of close eigenvalues, and brought
back by the reflections. The projection is sent to the tasks. A last centred covariance, of the
whitened rows, states how far it is from the identity.

Rows whose vector is null, has null or non-finite entries, or an entry over ``LARGEST`` after
quantising are left out. Every length of vector is a fit of its own, with its own mean, components
and error. Directions without variance (beyond rounding) have no whitened value and no row, so a
single vector, equal vectors and empty vectors give none. Repeated rows count each; ids may be null.
An empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.vectors import whole_vectors
from pairloom.storage import materialise

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
LARGEST = 1 << 31
# Eigenvalues this close, as a part of the matrix norm, are a cluster.
CLUSTER = 1e-3
# Whitened values that a task returns at once.
_HELD = 1 << 18
_EPS = np.finfo(np.float64).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections that lead there from a symmetric matrix."""
    a = np.array(matrix, np.float64)
    reflections = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        v[0] += np.copysign(norm, v[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        reflections.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2.0 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def reflected(vectors: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Columns brought back from the tridiagonal matrix to the original one."""
    out = vectors.copy()
    for k in reversed(range(len(reflections))):
        v = reflections[k]
        out[k + 1 :] -= 2.0 * np.outer(v, v @ out[k + 1 :])
    return out


def _negligible(diagonal: np.ndarray, off: np.ndarray) -> float:
    norm = max(np.abs(off).max(initial=0.0), np.abs(diagonal).max(initial=0.0))
    return max(norm * _EPS * _EPS, np.finfo(float).tiny)


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value."""
    tiny = _negligible(diagonal, off)
    count = np.zeros(len(at), np.int64)
    pivot = np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    high += _EPS * np.maximum(np.abs(low), np.abs(high)) + np.finfo(float).tiny
    rank, least = n - 1 - np.arange(k), _negligible(diagonal, off)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > least)
        if not open_.any():
            return low
        above = sturm_counts(diagonal, off, middle) <= rank
        low = np.where(open_ & above, middle, low)
        high = np.where(open_ & ~above, middle, high)


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - value) y = right by elimination with row exchanges."""
    n = len(diagonal)
    main, upper, second, y = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        below = [off[i], main[i + 1], upper[i + 1]]
        if abs(below[0]) > abs(main[i]):
            main[i], below[0] = below[0], main[i]
            upper[i], below[1] = below[1], upper[i]
            second[i], below[2] = below[2], second[i]
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(main[i]) < least:
            main[i] = least
        factor = below[0] / main[i]
        main[i + 1] = below[1] - factor * upper[i]
        upper[i + 1] = below[2] - factor * second[i]
        y[i + 1] -= factor * y[i]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in reversed(range(n)):
        known = (upper[i] * y[i + 1] if i + 1 < n else 0.0) + (second[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = (y[i] - known) / main[i]
    return np.array(y)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, for falling eigenvalues."""
    norm = max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0)) or 1.0
    rng = np.random.default_rng(0)
    out = np.zeros((len(diagonal), len(values)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        x = rng.normal(size=len(diagonal))
        for _ in range(4):
            x = _solved(diagonal / norm, off / norm, value / norm, x / np.linalg.norm(x), _EPS)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above rounding and their unit vectors as columns."""
    n = len(covariance)
    diagonal, off, reflections = tridiagonal(covariance)
    values = leading_values(diagonal, off, min(k, n))
    values = values[values > 4 * n * _EPS * max(values.max(initial=0.0), 0.0)]
    vectors = reflected(leading_vectors(diagonal, off, values), reflections)
    return values, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Fit:
    """What tasks need of one length of vector."""

    n: int
    sums: np.ndarray
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0
    mean: np.ndarray | None = None
    error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, whole numbers."""
        return self.n * x - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors, or whitened ones (less their mean, once it is known)."""
        y = self.deviations(x) / self.n
        if self.vectors is None:
            return y
        y = y @ self.vectors / np.sqrt(self.values)
        return y if self.mean is None else y - self.mean


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and vectors for every length in a batch of (part, vec_id, dims, x)."""
    lengths = batch.column(2).to_numpy()
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        raw = batch.column(3).take(pa.array(at)).to_pylist()
        yield int(dims), at, np.frombuffer(b"".join(raw), "<i8").reshape(len(at), dims)


def _whole(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, q in whole_vectors(batch.column(1), scale, LARGEST):
                packed = [x.tobytes() for x in (q + offset).astype("<i8")]
                columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), q.shape[1])), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dims", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("embedding is not null")
    rows = rows.mapInArrow(run, "vec_id long, dims long, x binary").where("dims > 0")
    return materialise(rows).select(F.spark_partition_id().alias("part"), "vec_id", "dims", "x")


def _summed(rows: DataFrame, partial, kind: str) -> dict[int, np.ndarray]:
    """Per length of vector the lines, in order, of a sum over all tasks of small matrices.

    ``partial`` gives a matrix for the vectors of a batch; lines of the tasks are added by task number.
    """
    element = "long" if kind == "<i8" else "double"

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = 0, {}
        for batch in batches:
            for dims, _, x in _matrices(batch):
                part = batch.column(0)[0].as_py()
                now = partial(dims, x)
                found[dims] = found[dims] + now if dims in found else now
        for dims, matrix in found.items():
            n = len(matrix)
            lines = pa.array([line.astype(kind).tobytes() for line in matrix], pa.binary())
            columns = [pa.array(np.full(n, v)) for v in (dims, part)]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(np.arange(n)), columns[1], lines], ["dims", "line", "part", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            numbers = pa.array([total.tolist()], pa.list_(pa.int64() if kind == "<i8" else pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), numbers], ["dims", "line", "v"])

        for batch in batches:
            for dims, line, _, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = np.frombuffer(v, kind)
                if (dims, line) == key:
                    total = total + now
                else:
                    if key:
                        yield done()
                    key, total = (dims, line), now
        if key:
            yield done()

    parts = rows.mapInArrow(per_task, "dims long, line long, part long, v binary")
    lined = parts.repartition("dims", "line").sortWithinPartitions("dims", "line", "part")
    # A line a dimension: what reaches the driver is bounded by the square of the dimensions.
    lines = lined.mapInArrow(added, f"dims long, line long, v array<{element}>").collect()
    out: dict[int, list] = {}
    for r in sorted(lines, key=lambda r: (r["dims"], r["line"])):
        out.setdefault(r["dims"], []).append(r["v"])
    return {dims: np.array(v, np.int64 if kind == "<i8" else np.float64) for dims, v in out.items()}


def _gram(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Sums of products of centred rows over their number."""

    def partial(dims: int, x: np.ndarray) -> np.ndarray:
        y = fits[dims].rows(x)
        return y.T @ y

    return {dims: m / fits[dims].n for dims, m in _summed(rows, partial, "<f8").items()}


def fit(rows: DataFrame, components: int) -> dict[int, Fit]:
    """Mean, components and remaining error of every length of vector."""

    def counted(dims: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(axis=0)])[None]

    fits = {dims: Fit(int(s[0][0]), s[0][1:]) for dims, s in _summed(rows, counted, "<i8").items()}
    for dims, covariance in _gram(rows, fits).items():
        f = fits[dims]
        f.values, f.vectors = principal(covariance, components)
        f.trace = float(np.trace(covariance))
    means = _summed(rows, lambda dims, x: fits[dims].rows(x).sum(axis=0)[None], "<f8")
    for dims, s in means.items():
        fits[dims].mean = s[0] / fits[dims].n
    for dims, covariance in _gram(rows, fits).items():
        fits[dims].error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0.0))
    for f in fits.values():
        f.mean = None
    return fits


def _square_sums(u: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond the range of long."""
    most = max(int(u.max(initial=0)), -int(u.min(initial=0)))
    if most * most * u.shape[1] < 1 << 63:
        return (u * u).sum(axis=1).tolist()
    exact = [sum(v * v for v in line) for line in u.tolist()]
    return [s if s < 1 << 63 else None for s in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = _whole(vectors, scale, offset)
    fits = fit(rows, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, places, vectors_ in _matrices(batch):
                f = fits[dims]
                k = len(f.values)
                step = max(_HELD // max(k, 1), 1)
                for at in range(0, len(places) if k else 0, step):
                    x = vectors_[at : at + step]
                    ids = batch.column(1).take(pa.array(np.repeat(places[at : at + step], k)))
                    deviation = pa.array(_square_sums(f.deviations(x)), pa.int64())
                    size = len(x) * k
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                            pa.array(np.full(size, f.n)),
                            deviation.take(pa.array(np.repeat(np.arange(len(x)), k))),
                            pa.array(f.rows(x).ravel()),
                            pa.array(np.tile(f.values / f.trace, len(x))),
                            pa.array(np.full(size, f.error)),
                        ],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return rows.mapInArrow(
        run,
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
