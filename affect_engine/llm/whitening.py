"""Embedding whitening: leading eigenvectors of a covariance by Jacobi-Davidson.

The covariance is never formed. All that touches the rows is the centred product
``y = X' (X b) / n`` for a block of vectors ``b``: each task adds up its rows,
Spark sums ``dimensions * block`` numbers, and a pass returns those. Rows are
centred before they are multiplied, as ``(n * x - S) / n`` from exact integers.

On the driver, in spaces no larger than a few blocks of vectors:

* Rayleigh-Ritz in the search space gives the approximate pairs and residuals.
* Pairs whose residual is at double precision are locked.
* For the others the correction equation ``(I - QQ')(A - e I)(I - QQ') t = -r``,
  ``Q`` the wanted vectors, is solved by a few MINRES steps; a step of all
  columns together is one distributed product.
* The corrections, made orthogonal, extend the space; beyond ``MAX_BLOCKS``
  blocks it is restarted from its best vectors.

Left out: vectors that are null or hold a null or non-finite component, and, as
a covariance needs one length, those of another length than the commonest (of
equally common ones the longest). Rows with equal or null ids are rows like any
other. Components whose variance is zero to rounding have no whitened value and
get no rows, so a single vector, or none, gives none at all. The sign of a
component is that which makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .centroids import matrix, usable
from .tables import saved, scratch

#: Vectors beyond the wanted ones in a block, blocks in the search space, inner steps, outer steps.
GUARD = 8
MAX_BLOCKS = 4
INNER = 6
OUTER = 60
#: Values of a slice of rows that is held as doubles.
PART_VALUES = 1 << 20

Product = Callable[[np.ndarray], np.ndarray]


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, PART_VALUES // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def whole(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """``floor(scale * c) + offset`` as integers."""
    x = np.floor(values.astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= 2.0**52:
        raise ValueError("a component is too large for an exact integer")
    return x.astype(np.int64) + offset


def _summed(rows: DataFrame, run, cast: str) -> np.ndarray:
    """Sum of the arrays that ``run`` gives for each task, of a fixed size."""
    cells = rows.mapInArrow(run, f"cell long, value {'long' if cast.startswith('decimal') else 'double'}")
    found = cells.groupBy("cell").agg(F.sum(F.col("value").cast(cast)).alias("value")).orderBy("cell").collect()
    return np.array([int(r.value) if cast.startswith("decimal") else r.value for r in found], object if cast.startswith("decimal") else float)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    flat = total.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], names=["cell", "value"])


def totals(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of each dimension, from rows ``(x)``."""

    def run(batches):
        out = np.zeros(dims + 1, np.int64)
        for part in _parts(batches, dims):
            x = matrix(part.column(0), dims)
            out[:dims] += x.sum(axis=0)
            out[dims] += len(x)
        yield _cells(out)

    out = _summed(rows, run, "decimal(38,0)")
    return int(out[dims]), out[:dims]


class Centring:
    """Exact centring of integer vectors: ``(n * x - S) / n``."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n = n
        # n * x - S = n * (x - base) - (S - n * base): small numbers for any offset.
        self.base = np.array([int(s) // n for s in sums], np.int64)
        self.rest = np.array([int(s) - n * int(b) for s, b in zip(sums, self.base, strict=True)], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact."""
        moved = x - self.base
        if moved.size and int(np.abs(moved).max()) * self.n >= 1 << 62:
            raise ValueError("n times a deviation doesn't fit 64 bits")
        return moved * self.n - self.rest

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) / float(self.n)


def centred_product(rows: DataFrame, centre: Centring) -> Product:
    """``b -> X'(X b) / n`` over centred rows ``(x)``, one pass each."""

    def product(block: np.ndarray) -> np.ndarray:
        dims = len(block)

        def run(batches):
            out = np.zeros(block.shape)
            for part in _parts(batches, dims):
                x = centre(matrix(part.column(0), dims))
                out += x.T @ (x @ block)
            yield _cells(out)

        return _summed(rows, run, "double").reshape(block.shape) / centre.n

    return product


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """What ``new`` adds to the bases, as orthonormal columns."""
    dims = len(new)
    base = np.column_stack([b for b in bases if b.shape[1]] or [np.zeros((dims, 0))])
    norms = np.linalg.norm(new, axis=0)
    new = new[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        new = new - base @ (base.T @ new)
        u, size, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, size > 1e-10]
    new = new - base @ (base.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def minres(product: Product, rights: np.ndarray, shifts: np.ndarray, keep: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Approximate ``t`` of ``keep (A - shift I) keep t = right``, all columns at once.

    Each column runs its own Lanczos recurrence; a step multiplies the current
    vectors of all columns by one distributed product.
    """
    dims, m = rights.shape
    beta = np.linalg.norm(rights, axis=0)
    v_old, v = np.zeros((dims, m)), rights / np.where(beta > 0, beta, 1)
    w_old, w = np.zeros((dims, m)), np.zeros((dims, m))
    c, s, c_old, s_old = np.ones(m), np.zeros(m), np.ones(m), np.zeros(m)
    eta, t, low = beta.copy(), np.zeros((dims, m)), np.zeros(m)
    tiny = np.finfo(float).tiny
    for _ in range(steps):
        p = keep(product(v)) - shifts * v
        p = keep(p)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - low * v_old
        high = np.linalg.norm(p, axis=0)
        # Apply the two previous rotations to the new column of the tridiagonal matrix, then a new one.
        delta = c * alpha - c_old * s * low
        rho = np.hypot(delta, high)
        rho_2 = s * alpha + c_old * c * low
        rho_3 = s_old * low
        c_old, s_old = c, s
        safe = np.where(rho > tiny, rho, 1)
        c, s = delta / safe, high / safe
        w_old, w = w, (v - rho_3 * w_old - rho_2 * w) / safe
        t = t + np.where(rho > tiny, c * eta, 0) * w
        eta = -s * eta
        going = high > 1e-14 * (np.abs(alpha) + np.abs(shifts) + tiny)
        v_old, v, low = v, np.where(going, p / np.where(high > 0, high, 1), 0), np.where(going, high, 0)
        if not going.any():
            break
    return t


def jacobi_davidson(product: Product, dims: int, wanted: int, seed: int = 13, inner: int = INNER, outer: int = OUTER) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors.

    Ends when every residual is at double precision, measured against the
    largest eigenvalue; raises when it doesn't get there.
    """
    wanted = min(wanted, dims)
    block = min(dims, wanted + GUARD)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, block)))[0]
    image = product(space)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    locked_image = np.zeros((dims, 0))
    for _ in range(outer):
        h = space.T @ image
        e, y = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-e)
        e, y = e[order], y[:, order]
        left = wanted - len(values)
        ritz, ritz_image = space @ y, image @ y
        top = max(float(np.max(values, initial=0.0)), float(np.max(e, initial=0.0)), np.finfo(float).tiny)
        limit = 16 * np.finfo(float).eps * np.sqrt(dims) * top
        residuals = ritz_image[:, :left] - ritz[:, :left] * e[:left]
        fine = np.linalg.norm(residuals, axis=0) <= limit
        # Only a leading run is locked, so that no larger value can be passed over.
        done = int(np.argmin(fine)) if not fine.all() else left
        locked = np.column_stack([locked, ritz[:, :done]])
        locked_image = np.column_stack([locked_image, ritz_image[:, :done]])
        values = np.append(values, e[:done])
        if len(values) >= wanted:
            break
        open_, e_open = ritz[:, done:left], e[done:left]
        space, image = ritz[:, done:], ritz_image[:, done:]
        if space.shape[1] > MAX_BLOCKS * block:
            space, image = space[:, :block], image[:, :block]
        fixed = np.column_stack([locked, open_])

        def keep(x, fixed=fixed):
            return x - fixed @ (fixed.T @ x)

        right = -keep(residuals[:, done:])
        new = orthonormal(minres(product, right, e_open, keep, inner), locked, space) if dims > space.shape[1] + len(values) else right[:, :0]
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + len(values)).standard_normal((dims, block)), locked, space)
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
        else:
            # The space is whole: fresh products rule out errors carried along.
            space = orthonormal(space, locked)
            image = product(space)
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenvectors did not reach double precision in {outer} steps")
    # Locked vectors were found one after another: a last rotation puts them in order.
    h = locked.T @ locked_image
    e, y = np.linalg.eigh((h + h.T) / 2)
    return e[::-1], (locked @ y)[:, ::-1]


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    *,
    scale: int = 64,
    offset: int = 1_000_000,
    components: int = 32,
) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``, a row per vector and component.

    A component ``c`` of a vector counts as the integer ``floor(scale * c) +
    offset``. ``deviation`` is the exact sum of ``(n * x - S)^2``, null where it
    doesn't fit 64 bits; ``explained`` the component's share of all variance;
    ``identity_error`` the largest entry of the whitened rows' covariance minus
    the identity, measured on the rows.
    """
    spark = vectors.sparkSession
    whole_rows = vectors.filter(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    key_type = whole_rows.schema["key"].dataType
    fields = T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")],
        ]
    )
    sizes = whole_rows.groupBy(F.size("vector").alias("dims")).count()
    common = sizes.filter("dims > 0").orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], fields)
    dims = common.dims
    rows = whole_rows.filter(F.size("vector") == dims)

    def integers(batches):
        for part in _parts(batches, dims):
            x = whole(matrix(part.column(0), dims), scale, offset)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.int64()))], names=["x"])

    with scratch(spark) as folders:
        fit = saved(rows.select("vector").mapInArrow(integers, "x array<long>"), "fit", folders)
        n, sums = totals(fit, dims)
        centre = Centring(n, sums)
        values, axes = jacobi_davidson(centred_product(fit, centre), dims, components)
        real = values > 64 * np.finfo(float).eps * max(values[0], 0.0)
        values, axes = values[real], axes[:, real]
        if not len(values):
            return spark.createDataFrame([], fields)
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)
        to_white = axes / np.sqrt(values)
        k = len(values)

        def spread(batches):
            out = np.zeros((k + 2, k))
            for part in _parts(batches, dims):
                x = centre(matrix(part.column(0), dims))
                white = x @ to_white
                out[:k] += white.T @ white
                out[k] += white.sum(axis=0)
                out[k + 1, 0] += (x * x).sum()
            yield _cells(out)

        found = _summed(fit, spread, "double").reshape(k + 2, k) / n
    mean = found[k]
    error = float(np.abs(found[:k] - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / found[k + 1, 0]

    def run(batches):
        for part in _parts(batches, max(dims, k)):
            m = part.num_rows
            scaled = centre.scaled(whole(matrix(part.column(1), dims), scale, offset))
            white = (scaled / float(n)) @ to_white
            fits = (scaled.astype(np.float64) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-9)
            deviation = pa.array((scaled**2).sum(axis=1), mask=~fits)
            row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    deviation.take(pa.array(row)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=fields.names,
            )

    return rows.mapInArrow(run, fields)
