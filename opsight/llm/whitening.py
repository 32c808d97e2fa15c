"""Whitening of embeddings by incremental eigendecomposition.

A vector's entries become whole numbers, so counts, sums and deviations are exact. Every partition keeps the spectrum
(eigenvalues and vectors) of the scatter of what it has seen. A block of centred rows enters by rank-one updates: each
solves a secular equation, after deflation of entries that cannot move an eigenvalue. A difference of means is one more
update. Two spectra are combined in the same way: the eigenvectors of one, scaled by their eigenvalues, are updates of
the other; `FAN_IN` spectra at a time are combined until one is left. Rounding gathered on the way is removed by a
distributed Rayleigh-Ritz step: the covariance within the basis found is counted over all rows and diagonalised.

What a task holds is a block of rows and a few d x d matrices; the driver gets d x d matrices and the sums.

Rows with a null vector, an empty one, or with a null or non-finite entry are dropped, and so are entries whose whole
number does not fit into 62 bits. If vectors differ in length, the commonest length (of equally common ones the longest) is fitted and returned;
others cannot be projected. Components without variance (constant or dependent dimensions, a single row) are left out.
Equal eigenvalues: any basis of their space. Null and repeated ids: each row is a row. Very long vectors cost d x d
memory. Empty table: no rows. Extra columns are not read. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import stored

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
BLOCK_BYTES = 4 << 20
FAN_IN = 16
EPS = np.finfo(float).eps
LARGEST = 1 << 62
SAFE = float(1 << 61)

_SPECTRUM = "part long, n long, sums array<decimal(38,0)>, levels array<double>, vectors array<double>"
_SPECTRUM_ARROW = pa.schema(
    [
        ("part", pa.int64()),
        ("n", pa.int64()),
        ("sums", pa.list_(pa.decimal128(38, 0))),
        ("levels", pa.list_(pa.float64())),
        ("vectors", pa.list_(pa.float64())),
    ]
)


# --- rank-one updates ------------------------------------------------------------------------------------------------


def deflated(levels: np.ndarray, z: np.ndarray, vectors: np.ndarray, rho: float) -> np.ndarray:
    """Which entries take part in the secular equation; rotates close levels in place, so that one of them drops out.

    An entry whose weight is below rounding leaves its eigenpair as it is. Of two levels that are equal within
    rounding, a rotation of their vectors moves the whole weight to one.
    """
    limit = 8 * EPS * max(float(np.abs(levels).max()), rho)
    active = rho * np.abs(z) > limit
    at = np.flatnonzero(active)
    if len(at) > 1:
        size = np.hypot(z[at[1:]], z[at[:-1]])
        close = np.abs(np.diff(levels[at]) * z[at[1:]] * z[at[:-1]]) <= limit * size * size
        if close.any():
            left = at[0]
            for right in at[1:]:
                norm = float(np.hypot(z[left], z[right]))
                c, s = z[right] / norm, z[left] / norm
                if abs((levels[right] - levels[left]) * c * s) <= limit:
                    z[right], z[left], active[left] = norm, 0.0, False
                    a, b = vectors[:, left].copy(), vectors[:, right]
                    vectors[:, left], vectors[:, right] = c * a - s * b, s * a + c * b
                    low, high = levels[left], levels[right]
                    levels[left], levels[right] = low * c * c + high * s * s, low * s * s + high * c * c
                left = right
    return active


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (d - x)) for rising d, and the matrix of root j minus pole i.

    There is one root above each pole. Roots are kept as offsets from the nearer pole, so differences from poles are
    exact to rounding. All roots are iterated at once by rational interpolation; a bracket is halved where a step
    leaves it.
    """
    k = len(d)
    weight = rho * z * z
    if k == 1:
        return d + weight, weight.reshape(1, 1)
    gap = np.append(np.diff(d), weight.sum())
    here = np.arange(k)
    half = gap / 2
    middle = 1 + (weight / (d - (d + half)[:, None])).sum(1)
    right = (middle < 0) & (here < k - 1)
    origin = here + right
    delta = d - d[origin][:, None]
    low = np.where(right, -half, np.where(middle < 0, half, 0.0))
    high = np.where(right, 0.0, np.where((middle < 0) & (here == k - 1), gap, half))
    x = (low + high) / 2
    below = here[None, :] <= here[:, None]
    own, above = delta[here, here], delta[here, np.minimum(here + 1, k - 1)]
    for _ in range(100):
        away = delta - x[:, None]
        terms = weight / away
        f = 1 + terms.sum(1)
        done = np.abs(f) <= k * EPS * (1 + np.abs(terms).sum(1))
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        if done.all():
            break
        slopes = terms / away
        psi = np.where(below, slopes, 0.0).sum(1)
        phi = slopes.sum(1) - psi
        first, second = own - x, above - x
        with np.errstate(all="ignore"):
            a = (first + second) * f - first * second * (psi + phi)
            b = first * second * f
            c = f - first * psi - second * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            last = first[-1] + psi[-1] * first[-1] ** 2 / (f[-1] - psi[-1] * first[-1])
        step[-1] = last  # one pole only: nothing lies above
        nearer = x + step
        bad = ~((nearer > low) & (nearer < high))
        nearer[bad] = ((low + high) / 2)[bad]
        stuck = nearer == x
        x = np.where(done, x, nearer)
        if (done | stuck).all():
            break
    return d[origin] + x, x[:, None] - delta


def rank_one(levels: np.ndarray, vectors: np.ndarray, update: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of vectors * diag(levels) * vectors' + weight * update * update'; levels rise."""
    z = vectors.T @ update
    norm = float(np.sqrt(z @ z))
    rho = weight * norm * norm
    if not rho > EPS * EPS * float(np.abs(levels).max(initial=0.0)):
        return levels, vectors
    levels, vectors, z = levels.copy(), vectors.copy(), z / norm
    active = deflated(levels, z, vectors, rho)
    at = np.flatnonzero(active)
    if len(at):
        at = at[np.argsort(levels[at], kind="stable")]
        d, k = levels[at], len(at)
        roots, apart = secular(d, z[at], rho)
        if k > 1:
            # the weights for which these roots are exact make the vectors orthogonal to rounding
            between = d[:, None] - d[None, :]
            np.fill_diagonal(between, 1.0)
            ratio = apart.copy()
            lower = np.arange(k)[:, None] < np.arange(k)[None, :]
            ratio[lower] /= between[lower]
            upper = np.zeros_like(ratio)
            upper[:-1] = between[1:]
            take = ~lower
            take[-1] = False
            ratio[take] /= upper[take]
            exact = np.copysign(np.sqrt(np.abs(ratio.prod(0)) / rho), z[at])
            turn = exact / -apart
            turn /= np.sqrt((turn * turn).sum(1))[:, None]
            vectors[:, at] = vectors[:, at] @ turn.T
        levels[at] = roots
    order = np.argsort(levels, kind="stable")
    return levels[order], vectors[:, order]


class Spectrum:
    """Number, sums and the spectrum of the scatter around the mean of a set of rows of whole numbers."""

    def __init__(self, d: int):
        self.n, self.sums = 0, np.array([0] * d, object)
        self.levels, self.vectors = np.zeros(d), np.eye(d)

    def _join(self, n: int, sums: np.ndarray, updates: np.ndarray) -> None:
        for row in updates:
            self.levels, self.vectors = rank_one(self.levels, self.vectors, row)
        if self.n and n:
            between = np.array((self.n * sums - n * self.sums) / (self.n * n), float)  # exact until divided
            self.levels, self.vectors = rank_one(self.levels, self.vectors, between, self.n * n / (self.n + n))
        self.n, self.sums = self.n + n, self.sums + sums

    def add(self, block: np.ndarray) -> None:
        """Centred rows as updates. More rows than dimensions come as the d rows of their triangular factor, which
        have the same scatter, so a block costs d updates."""
        sums = exact_sums(block)
        rows = deviations(block, len(block), sums) / len(block)
        self._join(len(block), sums, np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows)

    def merge(self, other: Spectrum) -> None:
        large, small = (self, other) if self.n >= other.n else (other, self)
        updates = (small.vectors * np.sqrt(np.maximum(small.levels, 0))).T[small.levels > 0]
        n, sums = small.n, small.sums
        self.n, self.sums, self.levels, self.vectors = large.n, large.sums, large.levels, large.vectors
        self._join(n, sums, updates)

    def row(self, part: int) -> pa.RecordBatch:
        values = [[part], [self.n], [[Decimal(int(s)) for s in self.sums]], [self.levels], [self.vectors.ravel()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SPECTRUM_ARROW)], schema=_SPECTRUM_ARROW)

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        d = len(row["sums"])
        out = cls(d)
        out.n, out.sums = row["n"], np.array([int(s) for s in row["sums"]], object)
        out.levels, out.vectors = np.array(row["levels"]), np.array(row["vectors"]).reshape(d, d)
        return out


# --- whole numbers ---------------------------------------------------------------------------------------------------


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums by column as Python integers."""
    if len(x) and float(np.abs(x.astype(float)).max()) * len(x) >= SAFE:
        x = x.astype(object)
    return np.array([int(v) for v in x.sum(0)], object)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers where they suffice, else Python integers; as floats divide by n."""
    base = sums // n if n else sums
    rest = sums - base * n
    largest = max((abs(int(b)) for b in base), default=0)
    if largest < LARGEST:
        near = x.astype(float) - base.astype(float)
        if len(x) == 0 or (np.abs(near).max() + 2) * n < SAFE:
            return (x - base.astype(np.int64)) * np.int64(n) - rest.astype(np.int64)
    return x.astype(object) * n - sums


def squares(deviation: np.ndarray) -> list[int | None]:
    """Row sums of squares; None beyond 64 bits."""
    rough = (deviation.astype(float) ** 2).sum(1)
    if deviation.dtype != object and (not len(rough) or rough.max() < SAFE):
        return (deviation * deviation).sum(1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in deviation]
    return [v if v < 1 << 63 else None for v in exact]


def block_rows(d: int) -> int:
    return max(2 * d, BLOCK_BYTES // (8 * d))


def matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and whole numbers of the vectors of length d that hold finite entries only."""
    rows = block_rows(d)
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        keep = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d)
        for start in range(0, len(keep), rows):
            chosen = pa.array(keep[start : start + rows])
            flat = column.take(chosen).flatten().cast(pa.float64())
            entries = flat.to_numpy(zero_copy_only=False).reshape(-1, d)  # null entries are NaN
            with np.errstate(all="ignore"):
                scaled = np.floor(SCALE * entries)
                good = (np.abs(scaled) < LARGEST).all(1)
            yield ids.take(chosen).filter(pa.array(good)).to_pylist(), scaled[good].astype(np.int64) + SHIFT


# --- distributed steps -----------------------------------------------------------------------------------------------


def valid(vectors: str) -> str:
    """SQL test for a vector that can be used: not null, not empty, all entries finite."""
    entry = "e IS NOT NULL AND NOT isnan(e) AND abs(CAST(e AS double)) < CAST('Infinity' AS double)"
    return f"{vectors} IS NOT NULL AND size({vectors}) > 0 AND forall({vectors}, e -> {entry})"


def commonest_length(df: DataFrame, vectors: str) -> int | None:
    """The length that most usable vectors have; of equally common ones the longest."""
    lengths = df.where(valid(vectors)).groupBy(F.size(vectors).alias("d")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else None


def combined(parts: DataFrame, merge: Callable[[list[dict]], pa.RecordBatch], label: str) -> dict | None:
    """One row out of many: groups of `FAN_IN` rows at a time become one, each level written to the shared folder."""

    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([merge(table.to_pylist())])

    parts = stored(parts, label)
    while (n := parts.count()) > 1:
        grouped = parts.withColumn("part", F.pmod(F.col("part"), F.lit(-(-n // FAN_IN)))).groupBy("part")
        parts = stored(grouped.applyInArrow(group, parts.schema), label)
    return next(iter(parts.toArrow().to_pylist()), None)


def spectrum(df: DataFrame, vectors: str, d: int) -> Spectrum | None:
    """Number, sums and spectrum over all rows: rank-one updates by partition, then combination."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum(d)
        for x in blocks(batches, d):
            found.add(x)
        if found.n:
            yield found.row(TaskContext.get().partitionId())

    def merge(rows: list[dict]) -> pa.RecordBatch:
        first, *rest = sorted((Spectrum.of(r) for r in rows), key=lambda s: -s.n)
        for other in rest:
            first.merge(other)
        return first.row(rows[0]["part"])

    found = combined(df.select(F.lit(0).alias("id"), vectors).mapInArrow(of_partition, _SPECTRUM), merge, "spectra")
    return Spectrum.of(found) if found else None


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Whole numbers of a partition in blocks of some megabytes, whatever the size of its batches."""
    held, n = [], 0
    for _, x in matrices(batches, d):
        held.append(x)
        n += len(x)
        if n >= block_rows(d):
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def scatter(df: DataFrame, vectors: str, n: int, sums: np.ndarray, basis: np.ndarray, label: str) -> np.ndarray:
    """Covariance (divisor n) of the centred rows projected on the columns of a basis, counted over all rows."""
    d, k = basis.shape

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), False
        for x in blocks(batches, d):
            y = (deviations(x, n, sums) / n).astype(float) @ basis
            total, seen = total + y.T @ y, True
        if seen:
            yield matrix_row(TaskContext.get().partitionId(), total)

    def merge(rows: list[dict]) -> pa.RecordBatch:
        return matrix_row(rows[0]["part"], reduce(np.add, [np.array(r["matrix"]) for r in rows]))

    parts = df.select(F.lit(0).alias("id"), vectors).mapInArrow(of_partition, "part long, matrix array<double>")
    return np.array(combined(parts, merge, label)["matrix"]).reshape(k, k) / n


def matrix_row(part: int, matrix: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([part], pa.int64()), pa.array([matrix.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "matrix"])


class Whitening(NamedTuple):
    """What is needed to whiten rows: d numbers or d x components."""

    n: int
    sums: np.ndarray
    basis: np.ndarray
    levels: np.ndarray
    explained: np.ndarray


def fit(df: DataFrame, vectors: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the covariance, largest first; None without usable rows."""
    d = commonest_length(df, vectors)
    found = spectrum(df, vectors, d) if d else None
    if found is None:
        return None
    basis, _ = np.linalg.qr(found.vectors)  # orthonormal but for rounding already
    ritz = scatter(df, vectors, found.n, found.sums, basis, "ritz")
    levels, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    levels, turn = levels[::-1], turn[:, ::-1]
    trace = float(np.trace(ritz))
    keep = np.flatnonzero(levels > 64 * d * EPS * max(trace, 0.0))[:components]
    basis = basis @ turn[:, keep]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    return Whitening(found.n, found.sums, basis, levels[keep], levels[keep] / trace if len(keep) else levels[keep])


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, vec_id: str = "vec_id", vectors: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component. `identity_error` is measured over all rows in a pass of its own."""
    model = fit(df, vectors, components)
    k = len(model.levels) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], WHITENED)
    n, sums, scaled = model.n, model.sums, model.basis / np.sqrt(model.levels)
    error = float(np.abs(scatter(df, vectors, n, sums, scaled, "identity") - np.eye(k)).max())
    numbers, share = np.arange(1, k + 1, dtype=np.int32), model.explained

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in matrices(batches, len(sums)):
            if not len(x):
                continue
            deviation = deviations(x, n, sums)
            values = (deviation / n).astype(float) @ scaled
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                pa.array(ids, pa.int64()).take(pa.array(each)),
                pa.array(np.tile(numbers, len(x))),
                pa.array(np.full(len(each), n)),
                pa.array(squares(deviation), pa.int64()).take(pa.array(each)),
                pa.array(values.ravel()),
                pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), vectors).mapInArrow(rows, WHITENED)
