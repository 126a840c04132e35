"""Whitening of embeddings by a distributed exact scatter and Jacobi rotations (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, staged
from tidewell.operators.sizes import spread

COMPONENTS = 4
#: Entries are taken as whole numbers of this part of one.
SCALE = 256
#: Rotations stop when no off-diagonal entry exceeds this part of its diagonal entries' geometric mean.
OFF_DIAGONAL, SWEEPS = 1e-16, 60
EXACT = 1 << 53
#: Rows that a task looks at together.
ROWS = 4096


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale c) of every entry as a long; beyond a long's range its ends."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * vectors)
    return np.where(np.abs(y) < 2.0 ** 63, y, 0).astype(np.int64) + np.where(y >= 2.0 ** 63, np.iinfo(np.int64).max, 0) + np.where(y < -2.0 ** 63, np.iinfo(np.int64).min, 0)


def encoded(x: np.ndarray) -> list[bytes]:
    """Bytes of each row, the same for equal rows only: 16-bit numbers where they do, else 64-bit ones."""
    narrow = (np.abs(x.astype(np.float64)) < 1 << 15).all(axis=1)
    return [row.astype("<i2").tobytes() if short else row.astype("<i8").tobytes() for row, short in zip(x, narrow.tolist(), strict=True)]


def decoded(keys: list[bytes], dim: int) -> np.ndarray:
    if all(len(k) == 2 * dim for k in keys):
        return np.frombuffer(b"".join(keys), "<i2").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(k, "<i2" if len(k) == 2 * dim else "<i8").astype(np.int64) for k in keys]).reshape(-1, dim)


def exact_products(z: np.ndarray) -> np.ndarray:
    """Sums over rows of z_i z_j as whole numbers; ``z`` holds whole numbers, as objects if they are large."""
    top = int(np.abs(z).max(initial=0)) if z.dtype == object else int(np.abs(z.astype(np.float64)).max(initial=0)) + 1
    if top and top * top <= EXACT:
        rows = max(1, EXACT // (top * top))
        parts = [z[k:k + rows].astype(np.float64) for k in range(0, len(z), rows)]
        return sum((np.dot(a.T, a).astype(np.int64).astype(object) for a in parts), np.zeros((z.shape[1], z.shape[1]), object))
    z = z.astype(object)
    return np.dot(z.T, z)


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Cyclic sweeps; each round of a sweep rotates pairs that share no index, as in a tournament, so all
    pairs meet once a sweep.  Entries are compared with their own diagonal entries, which keeps small
    eigenvalues accurate.  A vector's largest entry is positive.
    """
    a, n = np.array(a, np.float64), len(a)
    v = np.eye(n)
    seats = np.arange(n + n % 2)  # an odd one sits out against the number n
    for _ in range(SWEEPS if n > 1 else 0):
        rotated = False
        for _ in range(len(seats) - 1):
            p, q = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
            real = (p < n) & (q < n)
            p, q = p[real], q[real]
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > OFF_DIAGONAL * np.sqrt(np.abs(dp)) * np.sqrt(np.abs(dq))
            if turn.any():
                rotated = True
                p, q, off, dp, dq = p[turn], q[turn], off[turn], dp[turn], dq[turn]
                theta = (dq - dp) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                rows_p, rows_q = a[p], a[q]
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                for m in (a, v):
                    cols_p, cols_q = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
                a[p, q] = a[q, p] = 0.0
                a[p, p], a[q, q] = dp - t * off, dq + t * off
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not rotated:
            break
    values = np.diagonal(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0) if n else v
    return values[order], v


@dataclass
class Whitening:
    """A fit for vectors of one length: ``n`` distinct ones with sums ``s``; columns of ``matrix`` whiten what is centred."""

    n: int
    s: list[int]
    matrix: np.ndarray
    usable: np.ndarray  # components with any variance
    explained: np.ndarray
    error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - s, exactly."""
        top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        if max(self.n * top, *map(abs, self.s), 1) < EXACT:
            return self.n * x - np.array(self.s, np.int64)
        return x.astype(object) * self.n - np.array(self.s, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.matrix


def fitted(n: int, s: list[int], centre: list[int], first: dict[int, int], second: dict[tuple[int, int], int], components: int) -> Whitening:
    """From exact sums of distances from a whole-numbered centre, and of their products."""
    d = len(s)
    top = [first.get(j, 0) for j in range(d)]
    cov = np.zeros((d, d))
    trace = 0
    for i in range(d):
        for j in range(i, d):
            exact = n * second.get((i, j), 0) - top[i] * top[j]
            cov[i, j] = cov[j, i] = exact / (n * n)
            trace += exact if i == j else 0
    values, vectors = jacobi(cov)
    trace = trace / (n * n)
    k = min(components, d)
    values, vectors = values[:k], vectors[:, :k]
    usable = values > d * np.finfo(float).eps * trace
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, values, 1)), 0.0)
    return Whitening(n, s, vectors * scale, usable, np.maximum(values, 0) / trace if trace else np.zeros(k))


def _finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector, dim)`` of the rows whose vector has only finite entries."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & fine).withColumn("dim", F.size("vector")).where("dim > 0")


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, np.flatnonzero(dims == dim)


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """``(dim, i, j, s)``: whole numbers of up to 38 digits."""
    dims, i, j, s = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))], names=["dim", "i", "j", "s"])


SUMS_SQL = "dim int, i int, j int, s decimal(38, 0)"


def _added(per_task: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Sums over all tasks by length of vector; their number is that of matrix entries, whatever the rows."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in per_task.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        out.setdefault(r.dim, {})[r.i, r.j] = int(r.s)
    return out


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Every finite vector's place along the first principal components, each with variance one.

    ``(<id_col>, component, n, deviation, whitened, explained, identity_error)``, a row for each vector
    and component (numbered from 1 by falling variance, ``components`` or as many as a vector has entries).
    Entries count as whole numbers x = floor(``scale`` c).  The fit is over distinct x-vectors, so copies
    have no weight: ``n`` of them with sums S.  ``deviation`` is the exact sum of (n x - S)² (decimal, null beyond 38
    digits), ``explained`` the component's part of all variance, ``identity_error`` the largest entry by
    which the covariance of the fit list's whitened vectors differs from the identity, measured after the fit.

    The scatter is gathered by matrix products around a whole-numbered centre next to the mean, as whole numbers, and the exact mean's
    remainder is taken off exactly; so nothing is rounded before the covariance's entries are, and a
    task that runs again changes nothing.  The driver gets one such matrix (d² numbers for
    vectors of d entries, however many rows), turns it by Jacobi rotations and broadcasts d x ``components`` numbers.
    Distinct vectors are found by a grouping that combines copies before they are moved (two bytes an entry), written once, and read three times.

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped.  Vectors of another
    length are a space of their own with a fit of their own.  A component without variance (a single distinct
    vector, constant or dependent entries) can't be whitened: its ``whitened`` is null and it is left out of ``identity_error``
    (null if none is left).  Entries beyond a long count as its ends; where sums leave 38 digits (entries beyond about 1e15), Spark's
    decimal overflow ends the job.  Repeated rows, equal and null ids give rows each.  An empty table gives no rows.  Other columns are ignored.
    """
    rows = spread(_finite(vectors, id_col, vector_col))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_length(batch):
                got = encoded(whole_numbers(_matrix(batch.column("vector"), at, dim), scale))
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(got), pa.int32()), pa.array(got, pa.binary())], names=["dim", "key"])

    fit = staged(rows.select("vector", "dim").mapInArrow(keys, "dim int, key binary").distinct(), "fit-list")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """The fit list's vectors by length, some thousand at a time."""
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for dim, at in _by_length(part):
                    yield dim, decoded(part.column("key").take(pa.array(at)).to_pylist(), dim)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for dim, x in each(batches):
            got = sums.setdefault(dim, np.zeros(dim + 1, object))
            got[0] += len(x)
            got[1:] += (x.sum(axis=0) if np.abs(x.astype(np.float64)).max() < 1 << 40 else x.astype(object).sum(axis=0)).astype(object)
        yield _sums([(dim, i - 1, -1, int(v)) for dim, got in sums.items() for i, v in enumerate(got)])

    counted = {dim: (got[-1, -1], [got[i, -1] for i in range(dim)]) for dim, got in _added(fit.mapInArrow(totals, SUMS_SQL)).items()}
    centres = {dim: [(2 * t + n) // (2 * n) for t in s] for dim, (n, s) in counted.items()}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim, x in each(batches):
            plain = np.abs(x.astype(np.float64)).max() < 1 << 40 and max(map(abs, centres[dim])) < 1 << 40
            z = x - np.array(centres[dim], np.int64) if plain else x.astype(object) - np.array(centres[dim], object)
            first, second = sums.get(dim, (0, 0))
            sums[dim] = first + z.sum(axis=0).astype(object), second + exact_products(z)
        yield _sums([(dim, i, -1, int(first[i])) for dim, (first, _) in sums.items() for i in range(dim)] + [(dim, i, j, int(second[i, j])) for dim, (_, second) in sums.items() for i in range(dim) for j in range(i, dim)])

    models = {dim: fitted(*counted[dim], centres[dim], {i: v for (i, j), v in got.items() if j < 0}, {ij: v for ij, v in got.items() if ij[1] >= 0}, components)
              for dim, got in _added(fit.mapInArrow(scatter, SUMS_SQL)).items()} if counted else {}

    def spread_of_whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block of rows: their number, mean, and centred products."""
        for dim, x in each(batches):
            w = models[dim].whitened(models[dim].deviations(x))
            mean = w.mean(axis=0)
            centred = w - mean
            k = w.shape[1]
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([float(len(x))] * len(i)), pa.array(mean[i]), pa.array(mean[j]),
                                              pa.array((centred.T @ centred)[i, j])], names=["dim", "i", "j", "n", "a", "b", "s"])

    if models:
        blocks = fit.mapInArrow(spread_of_whitened, "dim int, i int, j int, n double, a double, b double, s double")
        n, a, b = F.col("n"), F.col("a"), F.col("b")
        cov = blocks.groupBy("dim", "i", "j").agg(((F.sum("s") + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum("n")) / F.sum("n")).alias("cov"))
        for r in cov.toLocalIterator():
            model = models[r.dim]
            if model.usable[r.i] and model.usable[r.j]:
                model.error = max(model.error or 0.0, abs(r["cov"] - (r.i == r.j)))
    discard(fit)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in _by_length(batch):
                model = shared.value[dim]
                y = model.deviations(whole_numbers(_matrix(batch.column("vector"), at, dim), scale))
                w = model.whitened(y)
                k = w.shape[1]
                if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * dim < 1 << 63:
                    deviation = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    sums = (y.astype(object) ** 2).sum(axis=1)
                    deviation = pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in sums], pa.decimal128(38, 0))
                times = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, model.n, np.int64)), deviation.take(times),
                     pa.array(w.ravel(), mask=np.tile(~model.usable, len(at))), pa.array(np.tile(model.explained, len(at))), pa.array([model.error] * (len(at) * k), pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(project, f"id {id_type}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
