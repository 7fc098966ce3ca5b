"""Nearest vectors by an inverted-file index, and over-sampling on top of it.

Centroids come from a bounded, seeded sample; every row goes into the list of its
nearest one, with its distance. A probe first searches the few lists nearest to
it. Its k-th hit then bounds the rest: a list whose centroid lies further off
than that hit plus the list's radius can hold nothing better, all others are
searched too. With ``exact=False`` the first search is the answer.

Lists of the first search are cut into blocks of about ``BLOCK_ROWS`` rows, and so
are the probes of a list, so a task holds two blocks however large a list is. The
other lists lie on shelves of about ``SHELF_ROWS`` rows. A probe goes to a shelf once,
however many of its lists it has to search, and its score so far keeps what can't
be better from leaving the task. A pair of blocks is a matrix product. Vectors that are null, of another length than the sampled
ones, hold a null or non-finite component, or (for the cosine) have no length
are left out. Equal scores go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .scan import RANGE, by_ranges, ordered_scan

SAMPLE_ROWS = 4096
LIST_ROWS = 1024
MOST_LISTS = 1024
BLOCK_ROWS = 4096
#: Rows of a shelf, and probes that search it in one task.
SHELF_ROWS, SHELF_PROBES = 16384, 8192
#: Rows of a matrix product.
STEP_ROWS = 1024
#: Lists a probe searches first.
FIRST_LISTS = 8
ROUNDS = 10
DIGITS = 12


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(square, 0))


def _centroids(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Seeded k-means on the sample; lists that run empty keep their centroid."""
    rng = np.random.default_rng(seed)
    at = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(ROUNDS):
        own = _distances(sample, at).argmin(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(at))
        at[count > 0] = sums[count > 0] / count[count > 0, None]
    return at


def _lists_of(numbers: np.ndarray, per_row: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))), pa.int32()), pa.array(numbers.astype(np.int32)))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if x.size else 0)), pa.array(x.ravel()))


def best_of_block(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, ties to the left; -inf never."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1, None]
        above, equal = scores > least, scores == least
        taken = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        taken = np.ones(scores.shape, bool)
    return np.nonzero(taken & np.isfinite(scores))


def _sized(df: DataFrame, group: list[str], name: str, most: int | None = None) -> DataFrame:
    # Written, so that Spark knows how few they are.
    return materialize(df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / (most or BLOCK_ROWS)).alias(name)), "block-counts")


def _search(visits: DataFrame, rows: DataFrame, k: int | None, cosine: bool, key_type: T.DataType) -> DataFrame:
    """``(probe, neighbour, score)`` of the visits ``(g, list, probe, x)`` to the lists of ``rows (g, list, key, x)``.

    The k best of each pair of blocks, all for k = None.
    """
    where = ["g", "list"]
    n_rows, n_probes = _sized(rows, where, "__nr"), _sized(visits, where, "__np")
    left = visits.join(n_rows, where).join(n_probes, where).select(
        *where, "probe", "x", F.pmod(F.xxhash64("probe"), F.col("__np")).alias("pb"), F.explode(F.sequence(F.lit(0), F.col("__nr") - 1)).alias("rb")
    )
    right = rows.join(n_probes, where).join(n_rows, where).select(
        *where, "key", "x", F.pmod(F.xxhash64("key"), F.col("__nr")).alias("rb"), F.explode(F.sequence(F.lit(0), F.col("__np") - 1)).alias("pb")
    )
    schema = T.StructType([T.StructField("probe", key_type), T.StructField("neighbour", key_type), T.StructField("score", T.DoubleType())])

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("key")
        probes, keys = a["probe"].combine_chunks(), b["key"].combine_chunks()
        x, y = _matrix(a["x"]), _matrix(b["x"])
        if not len(probes) or not len(keys):
            scores = np.zeros((0, 0))
        else:
            scores = x @ y.T
            if not cosine:
                scores = 2 * scores - (x * x).sum(axis=1)[:, None] - (y * y).sum(axis=1)
            scores = np.round(scores, DIGITS)
            same = pc.index_in(probes, keys).fill_null(-1).to_numpy()
            scores[np.flatnonzero(same >= 0), same[same >= 0]] = -np.inf
        at, to = best_of_block(scores, scores.shape[1] + 1 if k is None else k)
        return pa.table({"probe": probes.take(pa.array(at)), "neighbour": keys.take(pa.array(to)), "score": pa.array(scores[at, to] if len(at) else np.zeros(0))})

    block = [*where, "pb", "rb"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(pair, schema)


def _shelved(visits: DataFrame, rows: DataFrame, k: int, cosine: bool, key_type: T.DataType) -> DataFrame:
    """``(probe, neighbour, score)`` that may be among the k best, outside the lists that a probe has seen.

    ``visits (g, shelf, probe, x, seen, kth)``, ``rows (g, shelf, key, x, list)``.
    """
    where = ["g", "shelf"]
    n_rows, n_probes = _sized(rows, where, "__nr", SHELF_ROWS), _sized(visits, where, "__np", SHELF_PROBES)
    left = visits.join(n_rows, where).join(n_probes, where).select(
        *where, "probe", "x", "seen", "kth", F.pmod(F.xxhash64("probe"), F.col("__np")).alias("pb"), F.explode(F.sequence(F.lit(0), F.col("__nr") - 1)).alias("rb")
    )
    right = rows.join(n_probes, where).join(n_rows, where).select(
        *where, "key", "x", "list", F.pmod(F.xxhash64("key"), F.col("__nr")).alias("rb"), F.explode(F.sequence(F.lit(0), F.col("__np") - 1)).alias("pb")
    )
    schema = T.StructType([T.StructField("probe", key_type), T.StructField("neighbour", key_type), T.StructField("score", T.DoubleType())])

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        probes, at, to, score = a["probe"].combine_chunks(), [], [], []
        if a.num_rows and b.num_rows:
            b = b.sort_by("key")
            keys, x, y, own = b["key"].combine_chunks(), _matrix(a["x"]), _matrix(b["x"]), b["list"].to_numpy()
            same = pc.index_in(probes, keys).fill_null(-1).to_numpy()
            kth = a["kth"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            seen = np.zeros((len(probes), int(own.max()) + 1), bool)
            lists = a["seen"].combine_chunks()
            row, listed = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
            here = listed < seen.shape[1]
            seen[row[here], listed[here]] = True
            square = (y * y).sum(axis=1)
            for f in range(0, len(probes), STEP_ROWS):
                part = slice(f, f + STEP_ROWS)
                scores = x[part] @ y.T
                if not cosine:
                    scores = 2 * scores - (x[part] * x[part]).sum(axis=1)[:, None] - square
                hit = np.flatnonzero(same[part] >= 0)
                scores[hit, same[part][hit]] = -np.inf
                least = kth[part].copy()
                free = np.flatnonzero(np.isneginf(least))
                if len(free):
                    # Without hits so far the block's own k best are the bound.
                    open_scores = scores if len(free) == len(scores) else scores[free]
                    if len(row):
                        open_scores = scores[free] = np.where(seen[part][free][:, own], -np.inf, open_scores)
                    if scores.shape[1] > k:
                        least[free] = -np.partition(-open_scores, k - 1, axis=1)[:, k - 1] if k > 1 else open_scores.max(axis=1)
                # Rounding moves a score by less than this.
                r, c = np.nonzero(scores >= least[:, None] - 10.0**-DIGITS)
                new = ~seen[part][r, own[c]]
                r, c = r[new], c[new]
                found = np.round(scores[r, c], DIGITS)
                order = np.lexsort((c, -found, r))
                r, c, found = r[order], c[order], found[order]
                start = np.flatnonzero(np.diff(r, prepend=-1))
                rank = np.arange(len(r)) - np.repeat(start, np.diff([*start, len(r)]))
                kept = (rank < k) & np.isfinite(found)
                at.append(r[kept] + f), to.append(c[kept]), score.append(found[kept])
        if not at:
            return pa.table({"probe": probes[:0], "neighbour": probes[:0], "score": pa.array([], pa.float64())})
        at, to = pa.array(np.concatenate(at)), pa.array(np.concatenate(to))
        return pa.table({"probe": probes.take(at), "neighbour": keys.take(to), "score": pa.array(np.concatenate(score))})

    block = [*where, "pb", "rb"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(pair, schema)


def _prepared(df: DataFrame, key: str, vector: str, within: str | None, dims: int, cosine: bool, name: str) -> DataFrame:
    """Usable rows ``(g, name, x)``; unit vectors for the cosine."""
    kept = df.where(_usable(F.col(vector)) & (F.size(vector) == dims))
    x = F.col(vector).cast("array<double>")
    if cosine:
        size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
        kept = kept.where(size > 0)
    group = F.lit(0) if within is None else F.col(within)
    return kept.select(group.alias("g"), F.col(key).alias(name), x.alias("x"))


def nearest(
    probes: DataFrame,
    table: DataFrame,
    key: str,
    vector: str,
    k: int,
    *,
    metric: str = "cosine",
    within: str | None = None,
    exact: bool = True,
    first: int = FIRST_LISTS,
    lists: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``(probe, neighbour, score, rank)``: the k rows of ``table`` nearest to each probe, itself left out.

    ``score`` is the cosine or, for ``metric="euclidean"``, the squared distance
    times -1. With ``within`` only rows with the probe's value in that column count.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    cosine = metric == "cosine"
    spark = table.sparkSession
    key_type = table.schema[key].dataType
    rank = Window.partitionBy("probe").orderBy(F.desc("score"), "neighbour")
    sampled = table.where(_usable(F.col(vector))).select(F.xxhash64(key).alias("h"), F.col(vector).cast("array<double>").alias("x"))
    picked = [r.x for r in sampled.orderBy("h").limit(SAMPLE_ROWS).collect()]
    if not picked:
        return spark.createDataFrame([], T.StructType([T.StructField("probe", key_type), T.StructField("neighbour", key_type), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    sizes = [len(x) for x in picked]
    dims = max(sorted(set(sizes), reverse=True), key=sizes.count)
    sample = np.array([x for x in picked if len(x) == dims], np.float64)
    n = lists or max(1, min(MOST_LISTS, (table.count() if len(picked) == SAMPLE_ROWS else len(picked)) // LIST_ROWS))
    at = _centroids(_unit(sample) if cosine else sample, min(n, len(sample)), seed)

    def unit(x: np.ndarray) -> np.ndarray:
        return _unit(x) if cosine else x

    def assign(batches):
        for b in batches:
            x = unit(_matrix(b.column(2)))
            if len(x):
                d = _distances(x, at)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), b.column(1), _vectors(x), pa.array(d[np.arange(len(x)), own])], names=["g", "list", "key", "x", "d"])

    rows = _prepared(table, key, vector, within, dims, cosine, "key")
    listed = T.StructType([rows.schema["g"], T.StructField("list", T.IntegerType()), T.StructField("key", key_type), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("d", T.DoubleType())])
    rows = materialize(rows.mapInArrow(assign, listed), "vector-lists")
    asked = _prepared(probes, key, vector, within, dims, cosine, "probe")
    group_type = asked.schema["g"]
    visit = T.StructType([group_type, T.StructField("probe", key_type), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("list", T.ArrayType(T.IntegerType()))])
    few = min(first, len(at))

    def visits(df: DataFrame, choose: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], name: str) -> DataFrame:
        """Probes with each list that ``choose (distances, batch)`` marks."""

        def run(batches):
            for b in batches:
                x = unit(_matrix(b.column(2)))
                if len(x):
                    marked = choose(_distances(x, at), b)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _vectors(x), _lists_of(np.nonzero(marked)[1], marked.sum(axis=1))], names=["g", "probe", "x", "list"])

        found = df.mapInArrow(run, visit).select("g", "probe", "x", F.explode("list").alias("list"))
        return materialize(found, name)

    def near(d: np.ndarray) -> np.ndarray:
        marked = np.zeros(d.shape, bool)
        marked[np.arange(len(d))[:, None], np.argpartition(d, few - 1, axis=1)[:, :few]] = True
        return marked

    found = _search(visits(asked, lambda d, b: near(d), "first-visits"), rows, k, cosine, key_type)
    if not exact or few == len(at):
        return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    best = materialize(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "first-hits")
    # One number a list, whatever the table: the largest distance from its centroid.
    radius = np.full(len(at), -np.inf)
    for r in rows.groupBy("list").agg(F.max("d").alias("r")).collect():
        radius[r.list] = r.r
    kth = best.groupBy("probe").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    bounded = asked.join(kth, "probe", "left").select("g", "probe", "x", "kth")

    # Neighbouring lists share a shelf; a list is never cut between two.
    count = np.zeros(len(at), np.int64)
    for r in rows.groupBy("list").count().collect():
        count[r.list] = r["count"]
    line = np.argsort(_distances(at, at[:1])[:, 0], kind="stable")
    shelf_of = np.zeros(len(at), np.int32)
    shelf_of[line] = (np.cumsum(count[line]) - count[line]) // SHELF_ROWS
    shelves = int(shelf_of.max()) + 1

    def search_more(batches):
        for b in batches:
            x = unit(_matrix(b.column(2)))
            if len(x):
                d = _distances(x, at)
                score = b.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                reach = np.sqrt(np.maximum(2 - 2 * score if cosine else -score, 0))
                seen = near(d)
                wanted = (d - radius <= reach[:, None] + 1e-6) & ~seen
                marked = np.zeros((len(x), shelves), bool)
                row, listed = np.nonzero(wanted)
                marked[row, shelf_of[listed]] = True
                lists = [_lists_of(np.nonzero(m)[1], m.sum(axis=1)) for m in (seen, marked)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _vectors(x), b.column(3), *lists], names=["g", "probe", "x", "kth", "seen", "shelf"])

    numbers = T.ArrayType(T.IntegerType())
    more = T.StructType([group_type, T.StructField("probe", key_type), visit["x"], T.StructField("kth", T.DoubleType()), T.StructField("seen", numbers), T.StructField("shelf", numbers)])
    asked_more = materialize(bounded.mapInArrow(search_more, more), "other-visits").withColumn("shelf", F.explode("shelf"))
    shelf = F.get(F.array(*[F.lit(int(i)) for i in shelf_of]), F.col("list"))
    more = _shelved(asked_more, rows.select("g", "key", "x", "list", shelf.alias("shelf")), k, cosine, key_type)
    both = best.drop("rank").unionByName(more)
    return both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def similarities(probes: DataFrame, table: DataFrame, key: str, vector: str, best: bool = False) -> DataFrame:
    """``(probe, neighbour, cosine)`` of every row of ``table`` with each probe, in blocks.

    With ``best`` only a row's most similar probe, so a task gives one row for each
    of its rows and not one for each pair.
    """
    lengths = table.where(_usable(F.col(vector))).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = lengths.n if lengths else 0
    key_type = table.schema[key].dataType

    def units(df: DataFrame, name: str) -> DataFrame:
        rows = _prepared(df, key, vector, None, dims, True, name)
        size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
        scaled = rows.withColumn("__s", size).select("g", name, F.transform("x", lambda c: c / F.col("__s")).alias("x"))
        # Lists by hash: they only cut the table into parts.
        return scaled.withColumn("list", F.lit(0))

    visits, rows = materialize(units(probes, "probe"), "probes"), materialize(units(table, "key"), "vectors")
    if not best:
        return _search(visits, rows, None, True, key_type).withColumnRenamed("score", "cosine")
    # The rows of the table ask, the probes answer.
    none = F.array().cast("array<int>")
    asking = rows.select("g", F.lit(0).alias("shelf"), F.col("key").alias("probe"), "x", none.alias("seen"), F.lit(None).cast("double").alias("kth"))
    answering = visits.select("g", F.lit(0).alias("shelf"), F.col("probe").alias("key"), "x", "list")
    found = _shelved(asking, answering, 1, True, key_type)
    first = Window.partitionBy("probe").orderBy(F.desc("score"), "neighbour")
    top = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return top.select(F.col("neighbour").alias("probe"), F.col("probe").alias("neighbour"), F.col("score").alias("cosine"))


COPIES = 100_000


def oversample(df: DataFrame, key: str, label: str, vector: str, k: int = 5, seed: str = "42") -> DataFrame:
    """``(key, label, vector, seed_key, neighbour, copy)``: all rows, and points made for the smaller classes.

    Every class is filled up to the largest. Made point number ``copy`` of a
    class, with a null key, starts at the row at place ``copy`` (turning over) of a
    seeded order of the class and goes a seeded part of the way to one of that
    row's k nearest rows of the class, by distance. A class of one row repeats it.
    Rows whose vector or label can't be used are kept and not copied.
    """
    usable = df.where(_usable(F.col(vector)) & F.col(label).isNotNull())
    sizes = usable.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    # One row.
    wanted = sizes.join(F.broadcast(sizes.agg(F.max("__n").alias("__top"))), how="cross")
    short = materialize(wanted.where("__n < __top").withColumn("__missing", F.col("__top") - F.col("__n")), "short-classes")
    small = usable.join(short.select(label, "__n"), label)
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    seeds = _placed(small.select(label, key, vector, order.alias("__h")), label, key)
    near = nearest(small, small, key, vector, k, metric="euclidean", within=label)
    others = small.select(F.col(key).alias("neighbour"), F.col(vector).alias("__v"))
    around = near.join(others, "neighbour").groupBy(F.col("probe").alias(key)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "__v"))), lambda x: F.struct(x["neighbour"].alias("k"), x["__v"].alias("v"))).alias("__near")
    )
    seeds = materialize(seeds.join(around, key, "left").drop("__h"), "seed-rows")
    # Copies are numbered in runs of COPIES, so that no task makes all of a class.
    runs = short.select(label, "__n", "__missing", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__missing") - 1) / COPIES))).alias("__run"))
    last = F.least((F.col("__run") + 1) * COPIES, F.col("__missing")) - 1
    copies = runs.repartition(label, "__run").select(label, "__n", F.explode(F.sequence(F.col("__run") * COPIES, last)).alias("copy"))
    drawn = copies.withColumn("__place", F.col("copy") % F.col("__n")).join(seeds, [label, "__place"])

    def draw(name: str) -> Column:
        text = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("copy").cast("string"), F.lit(f":{seed}:{name}"))
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

    count = F.coalesce(F.size("__near"), F.lit(0))
    pick = F.when(count > 0, F.get("__near", F.pmod(draw("pick"), count).cast("int")))
    part = draw("part") / float(1 << 52)
    made = drawn.withColumn("__to", pick).withColumn("__part", part)
    way = F.zip_with(vector, F.coalesce(F.col("__to.v"), F.col(vector)), lambda a, b: a.cast("double") + F.col("__part") * (b.cast("double") - a.cast("double")))
    kind = df.schema[key].dataType
    new = made.select(F.lit(None).cast(kind).alias(key), label, way.cast(df.schema[vector].dataType).alias(vector), F.col(key).alias("seed_key"), F.col("__to.k").alias("neighbour"), "copy")
    nothing = F.lit(None)
    kept = df.select(key, label, vector, nothing.cast(kind).alias("seed_key"), nothing.cast(kind).alias("neighbour"), nothing.cast("long").alias("copy"))
    return kept.unionByName(new)


def _placed(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Rows numbered 0, 1, ... in ``__place`` along the hash inside their class."""
    dealt = by_ranges(rows, [label, "__h", key], "class-order")
    numbered = ordered_scan(dealt, [label], ["__h", key], F.col(RANGE), position="__pos")
    return numbered.withColumn("__place", F.col("__pos") - 1).drop("__pos", RANGE)
