"""Centroid clustering of vectors with a LAESA pivot table.

Vectors become whole numbers, so every distance, sum and floor is exact and the
result doesn't depend on the order of rows. The distances of each vector to a
few fixed pivots are computed once and stored beside it. In a round the pivots'
distances to the centroids are known on the driver; by the triangle inequality
the largest difference ``|d(vector, pivot) - d(centroid, pivot)|`` is a lower
bound for every centroid. The centroid of the smallest bound is measured first;
only centroids whose bound doesn't exceed that distance are measured too, all
in 64-bit integers.

A round is one pass without a shuffle of vectors: each task adds up its own
rows per cluster, and Spark sums ``clusters * dimensions`` numbers. The driver
holds centroids, pivots and the sample that pivots are chosen from, all of a
size set by parameters.

Left out: vectors that are null, have another number of components, or hold a
null or non-finite component. Rows with equal ids are rows of their own; a null
id can't be a first centroid but is clustered. With fewer kept vectors than
``clusters`` there are as many centroids as vectors, and with none no rows.
Equal distances go to the smaller centroid number. Components of ``2 ** 27``
and more after scaling are refused, as their distances don't fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import saved, scratch

#: Pivots, and the size of the sample (lowest hashes) they are chosen from.
PIVOTS = 16
PIVOT_SAMPLE = 256
LARGEST = 1 << 27
#: Components that are turned into integers at a time.
PART_VALUES = 1 << 20


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector is there, has ``dims`` components and only finite ones."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c.cast("double")))
    right = F.lit(True) if dims is None else F.size(vector) == dims
    return F.coalesce(vector.isNotNull() & right & finite, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Values of a list column whose lists all have ``dims`` entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integers."""
    x = np.floor(values.astype(np.float64) * scale)
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after scaling: its distances don't fit 64 bits")
    return x.astype(np.int64)


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each the farthest from those chosen before."""
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to each point; the squares are exact integers."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1).astype(np.float64))


class Centroids(NamedTuple):
    """Centroids of a round and their distances to the pivots."""

    at: np.ndarray
    to_pivots: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, pivots: np.ndarray) -> Centroids:
        return cls(at, distances(at, pivots))

    def nearest(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and its squared distance, for each row."""
        rows = np.arange(len(x))
        bound = np.zeros((len(x), len(self.at)))
        for pivot in range(to_pivots.shape[1]):
            np.maximum(bound, np.abs(to_pivots[:, pivot, None] - self.to_pivots[None, :, pivot]), out=bound)
        first = bound.argmin(axis=1)
        best = ((x - self.at[first]) ** 2).sum(axis=1)
        # A bound may be off by the rounding of two square roots, so a little is taken off.
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-12) + 1e-6
        left = bound <= reach[:, None]
        left[rows, first] = False
        number = first.copy()
        for c in range(len(self.at)):
            at = np.flatnonzero(left[:, c])
            if not len(at):
                continue
            d = ((x[at] - self.at[c]) ** 2).sum(axis=1)
            better = (d < best[at]) | ((d == best[at]) & (c < number[at]))
            best[at[better]], number[at[better]] = d[better], c
        return number, best


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    step = max(1, PART_VALUES // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def pivot_table(kept: DataFrame, pivots: np.ndarray, scale: int, folders: list[str]) -> DataFrame:
    """``(x, to_pivots)``: each vector as integers with its distances to the pivots."""
    dims = pivots.shape[1]

    def run(batches):
        for part in _parts(batches, dims):
            x = whole(matrix(part.column(0), dims), scale)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), dims).cast(pa.list_(pa.int32())),
                    pa.FixedSizeListArray.from_arrays(pa.array(distances(x, pivots).ravel()), len(pivots)).cast(pa.list_(pa.float64())),
                ],
                names=["x", "to_pivots"],
            )

    return saved(kept.select("vector").mapInArrow(run, "x array<int>, to_pivots array<double>"), "pivots", folders)


def _sums(stored: DataFrame, centroids: Centroids) -> np.ndarray:
    """Per cluster: sums of the components, number of vectors, sum of the distances."""
    k, dims = centroids.at.shape
    n_pivots = centroids.to_pivots.shape[1]

    def run(batches):
        total = np.zeros((k, dims + 2), np.int64)
        for part in _parts(batches, dims):
            x = matrix(part.column(0), dims).astype(np.int64)
            number, best = centroids.nearest(x, matrix(part.column(1), n_pivots))
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            rows = np.column_stack([x, np.ones(len(x), np.int64), best])[order]
            if len(starts):
                total[number[order][starts]] += np.add.reduceat(rows, starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    parts = stored.mapInArrow(run, "cell long, value long")
    cells = parts.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()
    out = np.zeros(k * (dims + 2), object)
    for cell, value in cells:
        out[cell] = int(value)
    return out.reshape(k, dims + 2)


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    *,
    dims: int = 64,
    scale: int = 256,
    clusters: int = 40,
    rounds: int = 5,
    seed: str = "2",
    pivots: int = PIVOTS,
) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256)`` of every kept vector.

    The first centroids are the vectors with the smallest SHA-256 of
    ``<seed>:<key>``. Each round assigns all vectors and moves every centroid
    that has any to the floor of their mean. ``distance`` is squared, to the
    final centroid, and the inertias are its sums over the cluster and over all.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col(vector), dims)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    key_type = kept.schema["key"].dataType
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    ranked = kept.withColumn("mark", mark).orderBy(F.col("mark").asc_nulls_last(), "vector")
    sample = ranked.limit(max(clusters, PIVOT_SAMPLE)).collect()
    fields = [
        T.StructField(key, key_type),
        *[T.StructField(c, T.LongType()) for c in ("cluster", "distance", "cluster_inertia", "inertia")],
        T.StructField("centroid", T.ArrayType(T.LongType())),
        T.StructField("centroid_sha256", T.StringType()),
    ]
    if not sample:
        return spark.createDataFrame([], T.StructType(fields))
    points = whole(np.array([r.vector for r in sample], np.float64), scale)
    fixed = farthest_first(points, pivots)
    named = [i for i, r in enumerate(sample) if r.mark is not None][:clusters] or [0]
    now = Centroids.of(points[named], fixed)
    with scratch(spark) as folders:
        stored = pivot_table(kept, fixed, scale, folders)
        for _ in range(rounds):
            sums = _sums(stored, now)
            at = now.at.copy()
            for c, row in enumerate(sums):
                if row[dims]:
                    at[c] = [int(s) // int(row[dims]) for s in row[:dims]]
            now = Centroids.of(at, fixed)
        inertia = [int(row[dims + 1]) for row in _sums(stored, now)]

    def run(batches):
        for part in _parts(batches, dims):
            x = whole(matrix(part.column(1), dims), scale)
            number, best = now.nearest(x, distances(x, fixed))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int64()), pa.array(best, pa.int64())], names=["key", "cluster", "distance"])

    assigned = kept.mapInArrow(run, T.StructType([T.StructField("key", key_type), *fields[1:3]]))
    per_cluster = [
        (c, inertia[c], sum(inertia), [int(v) for v in at], hashlib.sha256(",".join(str(int(v)) for v in at).encode()).hexdigest())
        for c, at in enumerate(now.at)
    ]
    # One row a centroid: its size is set by the parameter.
    about = F.broadcast(spark.createDataFrame(per_cluster, T.StructType([fields[1], *fields[3:]])))
    return assigned.join(about, "cluster").select(F.col("key").alias(key), *[f.name for f in fields[1:]])
