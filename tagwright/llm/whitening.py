"""Whitening of embeddings by their principal components, found by contour integration.

Entries become whole numbers, so that the sums over all vectors are exact.  Spark makes
the list of different vectors, their sums and their covariance; the driver holds one
matrix as wide as a vector.  Its largest eigenvalues are enclosed by counts of pivots'
signs (inertia), and for every enclosed interval a quadrature of shifted solves along a
circle around it (FEAST) projects random vectors onto the interval's eigenvectors.
Rayleigh-Ritz takes them out of the projected space; the counts tell that none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.textbytes import field_names
from tagwright.session import write_once

#: Components that are returned at most, and whole steps of one unit of an entry.
COMPONENTS = 4
SCALE = 256

#: Points of the quadrature on the upper half of a circle, and rounds of projecting.
POINTS = 8
ROUNDS = 200
_EPS = float(np.finfo(float).eps)
#: Residual of a pair, as a share of the largest eigenvalue, that is worked for and that is accepted.
RESIDUAL, ACCEPTED = 32 * _EPS, 1e-11


# --- eigenvalues and vectors of one symmetric matrix ---------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a matrix with the same eigenvalues, by reflections."""
    a = np.array(matrix, float)
    for i in range(len(a) - 2):
        v = a[i + 1 :, i].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        rest = a[i + 1 :, i + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[i + 1 :, i] -= 2 * v * (v @ a[i + 1 :, i])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, side: np.ndarray, at: float) -> int:
    """Inertia: as many eigenvalues are above ``at`` as pivots of the matrix less ``at`` are positive."""
    least = _EPS * max(1e-300, float(np.abs(diagonal).max(initial=0.0) + np.abs(side).max(initial=0.0)))
    count, pivot = 0, 1.0
    for d, s in zip(diagonal, [0.0, *side]):
        pivot = d - at - s * s / pivot
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


def _enclosed(diagonal: np.ndarray, side: np.ndarray, number: int, low: float, high: float) -> float:
    """The ``number``-th largest eigenvalue, by halving between counts."""
    while high - low > 4 * _EPS * max(abs(low), abs(high)):
        middle = (low + high) / 2
        if above(diagonal, side, middle) >= number:
            low = middle
        else:
            high = middle
        if middle in (low, high) and (low + high) / 2 in (low, high):
            break
    return (low + high) / 2


def intervals(diagonal: np.ndarray, side: np.ndarray, wanted: int, top: float) -> list[tuple[float, float, int]]:
    """Intervals, from the top, that hold at least the ``wanted`` largest eigenvalues; and how many each holds.

    They end in the middle of the gap below and as far above what they hold;
    eigenvalues that are all but equal share one.
    """
    found, done, number = [], 0, 0
    first = before = _enclosed(diagonal, side, 1, -top, top) if wanted else 0.0
    while done < wanted:
        number += 1
        after = _enclosed(diagonal, side, number + 1, -top, before) if number < len(diagonal) else before - max(abs(before), _EPS)
        if before - after > 1e-9 * top:
            low = (before + after) / 2
            high = min(first + before - low, found[-1][0] if found else np.inf)
            count = above(diagonal, side, low) - done
            found.append((low, high, count))
            done, first = done + count, after
        before = after
    return found


def project(matrix: np.ndarray, low: float, high: float, start: np.ndarray) -> np.ndarray:
    """``start`` filtered by the integral of the resolvent along the circle over ``low`` and ``high``.

    What lies inside the interval stays and the rest nearly vanishes: Gauss quadrature
    over the upper half, as the lower half is its conjugate.
    """
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(start)
    for x, w in zip(nodes, weights):
        turn = np.exp(0.5j * np.pi * (1 + x))
        solved = np.linalg.solve((middle + radius * turn) * np.eye(len(matrix)) - matrix, start.astype(complex))
        out += 0.5 * w * (radius * turn * solved).real
    return out


def _ritz(matrix: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors of the matrix within a space."""
    left, sizes, _ = np.linalg.svd(space, full_matrices=False)
    basis = left[:, sizes > 1e-13 * sizes[0]] if len(sizes) and sizes[0] > 0 else left
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1], (basis @ turned)[:, ::-1]


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, falling, and their vectors."""
    n, size = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    space = np.random.default_rng(1).standard_normal((n, min(n, 2 * count + 4)))
    best, last, stalled = None, np.inf, 0
    for _ in range(ROUNDS):
        values, space = _ritz(matrix, project(matrix, low, high, space))
        inside = (values > low) & (values <= high)
        if inside.sum() == count:
            pairs = values[inside], space[:, inside]
            worst = np.abs(matrix @ pairs[1] - pairs[1] * pairs[0]).max() / size
            # At the limit of the arithmetic rounds gain nothing any more.
            stalled = stalled + 1 if worst > 0.9 * last else 0
            if worst < last:
                best, last = pairs, worst
            if last <= RESIDUAL or stalled == 3:
                break
    if best is None or last > ACCEPTED:
        raise RuntimeError(f"{count} eigenvalues between {low} and {high} were counted but not found")
    return best


def largest(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a positive semidefinite matrix, falling, and unit vectors.

    Values that are zero within rounding are left out.  The largest entry of a vector
    is positive.
    """
    size = float(np.trace(matrix))
    if not size > 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled = matrix / size
    diagonal, side = tridiagonal(scaled)
    wanted = min(wanted, above(diagonal, side, 8 * len(matrix) * _EPS))
    # No eigenvalue of a semidefinite matrix is above its trace.
    parts = [feast(scaled, *part) for part in intervals(diagonal, side, wanted, 1.5)] if wanted else []
    if not parts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    # Once more over all intervals, which makes the vectors orthogonal across them.
    values, vectors = _ritz(scaled, np.concatenate([p[1] for p in parts], axis=1))
    if len(values) != sum(len(p[0]) for p in parts):
        raise RuntimeError("vectors of different eigenvalues coincide")
    vectors = vectors[:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values[:wanted] * size, vectors * signs


# --- sums over all vectors ------------------------------------------------------


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


class Centre(NamedTuple):
    """Exact sums of ``n`` vectors, and what they make of a vector."""

    n: int
    sums: list[int]

    def less(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision: the whole part of the mean is taken off exactly."""
        whole = [s // self.n for s in self.sums]
        part = np.array([s % self.n / self.n for s in self.sums])
        if len(x) and (np.abs(x.astype(float)).max() > 2.0**61 or max(map(abs, whole)) > 1 << 61):
            return x.astype(float) - np.array(whole, float) - part
        return (x - np.array(whole, np.int64)).astype(float) - part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n*x - S)^2, exact; null where it is beyond a long."""
        most = self.n * float(np.abs(x.astype(float)).max(initial=0.0)) + float(max(map(abs, self.sums)))
        if x.shape[1] * most**2 < 2.0**62:
            return pa.array(((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1))
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


_SUMS = "place int, n long, high long, low long"


def _sum(width: int) -> Callable:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            n += len(x)
            # In two halves of 32 bits, whose sums cannot overflow.
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            columns = [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(columns, names=field_names(_SUMS))

    return summed


def _products(of: Callable[[np.ndarray], np.ndarray], width: int) -> Callable:
    """Sums of products of the columns that ``of`` makes, a row per column; the last are the sums themselves."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = of(_matrix(batch, width))
                y = np.concatenate([y, np.ones((len(y), 1))], axis=1)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            flat = pa.array(total.ravel())
            offsets = pa.array(np.arange(0, total.size + 1, len(total), dtype=np.int32))
            rows = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(offsets, flat)], names=["place", "products"])

    return multiplied


def _covariance(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int, columns: int) -> np.ndarray:
    """Covariance of the columns that ``of`` makes of the listed vectors; at most a number per two columns is collected."""
    found = fit.mapInArrow(_products(of, width), "place int, products array<double>")
    cells = found.select("place", F.posexplode("products").alias("other", "product"))
    total = np.zeros((columns + 1, columns + 1))
    for row in cells.groupBy("place", "other").agg(F.sum("product").alias("product")).collect():
        total[row["place"], row["other"]] = row["product"]
    n = total[columns, columns]
    mean = total[columns, :columns] / n
    return total[:columns, :columns] / n - np.outer(mean, mean)


class Whitener(NamedTuple):
    """Mean, components and their eigenvalues; ``axes`` has a column per component, over the root of its eigenvalue."""

    width: int
    centre: Centre
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def _whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def wholes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)``: entries as whole steps, of the vectors that have finite entries only."""
    usable = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").alias("vector"))
    usable = usable.filter(_usable(F.col("vector")))
    return usable.select("vec_id", _whole(F.col("vector"), scale).alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Learn from the different vectors of ``rows(vec_id, x)``; None without any."""
    # Vectors of one width can be compared; a row per width is collected.
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    top = widths.agg(F.max_by("width", F.struct("n", "width"))).first()[0]
    if top is None:
        return None
    # Equal vectors meet in the task before the exchange.
    listed = write_once(rows.filter(F.size("x") == top).select("x").distinct(), "whitening-vectors")
    counted = listed.mapInArrow(_sum(top), _SUMS).groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    found = sorted(counted.collect(), key=lambda r: r["place"])
    centre = Centre(found[0]["n"], [(r["high"] << 32) + r["low"] for r in found])
    covariance = _covariance(listed, centre.less, top, top)
    values, vectors = largest((covariance + covariance.T) / 2, components)
    axes = vectors / np.sqrt(values)
    error = 0.0
    if len(values):
        white = _covariance(listed, lambda x: centre.less(x) @ axes, top, len(values))
        error = float(np.abs(white - np.eye(len(values))).max())
    return Whitener(top, centre, values, axes, values / np.trace(covariance) if len(values) else values, error)


_WHITE = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
)


def _apply(model: Whitener) -> Callable:
    k = len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, model.width)
            each = np.repeat(np.arange(len(x)), k)
            of = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(each)),
                    pa.array((of + 1).astype(np.int32)),
                    pa.array(np.full(len(each), model.centre.n)),
                    model.centre.deviation(x).take(pa.array(each)),
                    pa.array((model.centre.less(x) @ model.axes).ravel()),
                    pa.array(model.explained[of]),
                    pa.array(np.full(len(each), model.identity_error)),
                    pa.array(model.values[of]),
                ],
                names=field_names(_WHITE),
            )

    return apply


def whitened(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """A row per vector and component, at most ``components``, with the vector's whitened coordinate.

    Vectors that are null or empty, or hold a null or an entry that is not finite,
    are left out, and so are vectors of another width than most rows have (the
    wider of two as frequent).  Equal vectors are learnt from once, whatever their
    ids, and each of their rows is returned; null and repeated ids are ids like
    others.  Entries whose steps are beyond a long are the largest long; a
    ``deviation`` beyond a long is null.  Components without spread do not exist, so
    there are fewer for narrow or few vectors, and no rows if all are equal or the
    table is empty.  Components of equal eigenvalues are some axes of their space.
    """
    rows = wholes(vectors, id_column, vector_column, scale)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], _WHITE)
    return rows.filter(F.size("x") == model.width).mapInArrow(_apply(model), _WHITE)
