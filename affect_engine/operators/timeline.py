"""Resampling of a recording's predictions to an even grid.

Nothing gathers a recording: each grid point finds the segment before it with
an as-of scan and reads a fixed neighbourhood by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .scan import chunk_of, ordered_scan

TIME_CHUNK = 3600.0
KNOT_CHUNK = 1024


def knots(rows: DataFrame, key: str = "video_id", order: str = "segment_id") -> DataFrame:
    """Midpoints numbered 0, 1, ... with defaults for missing values."""
    filled = rows.select(
        key,
        order,
        ((F.col("start") + F.col("end")) / 2).alias("t"),
        F.coalesce("arousal", F.lit(0.5)).alias("arousal"),
        F.coalesce("valence", F.lit(0.5)).alias("valence"),
        "emotion_id",
        "agreement",
    )
    return ordered_scan(
        filled, [key], [order], chunk_of(F.col(order), 4096), position="__pos"
    ).select(key, (F.col("__pos") - 1).alias("k"), "t", "arousal", "valence", "emotion_id", "agreement")


def grid(rows: DataFrame, points: int, key: str = "video_id") -> DataFrame:
    """``points`` even times from the first start to the last end."""
    span = rows.groupBy(key).agg(F.min("start").alias("__a"), F.max("end").alias("__b"))
    step = (F.col("__b") - F.col("__a")) / (points - 1)
    return span.select(
        key, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"), "__a", step.alias("__s")
    ).select(key, "g", (F.col("__a") + F.col("g") * F.col("__s")).alias("t"))


def bracket(points: DataFrame, marks: DataFrame, key: str = "video_id") -> DataFrame:
    """Grid points with ``k``, the left knot of the span that serves them.

    Points outside the knots use the first or last span.
    """
    line = points.select(key, "t", F.lit(1).alias("__kind"), "g", F.lit(None).cast("long").alias("k")).unionByName(
        marks.select(key, "t", F.lit(0).alias("__kind"), F.lit(0).alias("g"), "k")
    )
    seen = ordered_scan(
        line, [key], ["t", "__kind", "g"], chunk_of(F.col("t"), TIME_CHUNK), carry={"__k": F.col("k")}
    ).where("__kind = 1")
    top = marks.groupBy(key).agg(F.max("k").alias("__top"))
    inner = F.greatest(F.lit(0), F.least(F.coalesce("__k", F.lit(0)), F.col("__top") - 1))
    return seen.join(top, key).select(key, "g", "t", inner.cast("long").alias("k"))


def _ends(points: DataFrame, marks: DataFrame, key: str, columns: list[str]) -> DataFrame:
    left = marks.select(key, "k", F.col("t").alias("t0"), *[F.col(c).alias(f"{c}0") for c in columns])
    right = marks.select(
        key, (F.col("k") - 1).alias("k"), F.col("t").alias("t1"), *[F.col(c).alias(f"{c}1") for c in columns]
    )
    return points.join(left, [key, "k"]).join(right, [key, "k"], "left")


def linear_and_nearest(points: DataFrame, marks: DataFrame, key: str = "video_id") -> DataFrame:
    """Agreement interpolated linearly (clipped to [0, 1]), emotion from the nearest knot."""
    spans = _ends(points, marks, key, ["agreement", "emotion_id"])
    share = F.try_divide(F.col("t") - F.col("t0"), F.col("t1") - F.col("t0"))
    line = F.col("agreement0") + F.coalesce(share * (F.col("agreement1") - F.col("agreement0")), F.lit(0.0))
    closer = F.col("t1").isNull() | (F.col("t") - F.col("t0") <= F.col("t1") - F.col("t"))
    return spans.select(
        key,
        "g",
        "t",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), line)).alias("agreement"),
        F.when(closer, F.col("emotion_id0")).otherwise(F.col("emotion_id1")).alias("emotion_id"),
    )


def _equations(k: np.ndarray, t: np.ndarray, y: np.ndarray, row: np.ndarray, own: np.ndarray):
    """Tridiagonal equations for the curvatures at the knots ``own``, inner knots of their recording.

    ``k, t, y`` hold a chunk's knots and its neighbours' next ones. The two
    not-a-knot conditions are put into the first and the last equation.
    """
    h0, h1 = t[own] - t[own - 1], t[own + 1] - t[own]
    right = 6 * ((y[:, own + 1] - y[:, own]) / h1 - (y[:, own] - y[:, own - 1]) / h0)
    lower, middle, upper = h0.copy(), 2 * (h0 + h1), h1.copy()
    first = k[own] == 1
    after = np.minimum(own + 2, len(k) - 1)
    last = (own + 2 >= len(k)) | (row[after] != row[own])
    middle[first] += (h0 * (h0 + h1) / h1)[first]
    upper[first] -= (h0**2 / h1)[first]
    middle[last] += (h1 * (h0 + h1) / h0)[last]
    lower[last] -= (h1**2 / h0)[last]
    lower[first], upper[last] = 0, 0
    return lower, middle, upper, right, last


def _sweep(lower: np.ndarray, middle: np.ndarray, upper: np.ndarray, rights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Solutions of one tridiagonal system a row, for all right sides; the rows advance together."""
    size = np.diff(bounds)
    lanes = np.argsort(-size, kind="stable")
    start, size = bounds[:-1][lanes], size[lanes]
    out, over = rights.copy(), np.zeros(len(middle))
    longest = int(size[0]) if len(size) else 0
    live = [start[: np.searchsorted(-size, -j, side="left")] + j for j in range(longest)]
    for j, at in enumerate(live):
        pivot = middle[at].copy()
        if j:
            pivot -= lower[at] * over[at - 1]
            out[:, at] -= lower[at] * out[:, at - 1]
        over[at] = upper[at] / pivot
        out[:, at] /= pivot
    for j in range(longest - 2, -1, -1):
        at = live[j + 1] - 1
        out[:, at] -= over[at] * out[:, at + 1]
    return out


_BORDER = ("first_0", "first_1", "first_l", "first_r", "last_0", "last_1", "last_l", "last_r")


def _chunk_knots(batch: pa.RecordBatch, column: int):
    knots = batch.column(column)
    fields = knots.flatten().flatten()
    k, t, a, v = (np.asarray(f.to_numpy(zero_copy_only=False)) for f in fields[:4])
    size = knots.value_lengths().to_numpy(zero_copy_only=False)
    return k, t, np.stack([a, v]), np.repeat(np.arange(len(size)), size)


def _inner(k: np.ndarray, row: np.ndarray, c: np.ndarray, chunk: int) -> np.ndarray:
    """Places of a chunk's own knots that have a knot on both sides, in recordings of four and more."""
    n = len(k)
    at = np.arange(n)
    here = (k // chunk == c[row]) & (k >= 1) & (at + 1 < n)
    here[here] &= row[at[here] + 1] == row[at[here]]
    few = np.maximum.reduceat(k, np.searchsorted(row, np.arange(len(c)))) < 3 if n else np.zeros(0, bool)
    return at[here & ~(few[row] & (c[row] == 0))]


def _local(batch: pa.RecordBatch, keys: int, chunk: int):
    """A chunk's curvatures as ``p + l * (last of the chunk before) + r * (first of the chunk after)``."""
    c = batch.column(keys).to_numpy()
    k, t, y, row = _chunk_knots(batch, keys + 1)
    own = _inner(k, row, c, chunk)
    lower, middle, upper, right, last = _equations(k, t, y, row, own)
    bounds = np.searchsorted(row[own], np.arange(len(c) + 1))
    filled = np.diff(bounds) > 0
    begin, end = bounds[:-1][filled], bounds[1:][filled] - 1
    sides = np.zeros((2, len(own)))
    sides[0, begin], sides[1, end] = -lower[begin], -upper[end]
    return c, k, t, y, row, own, last, bounds, filled, begin, end, _sweep(lower, middle, upper, np.vstack([right, sides]), bounds)


def _border_rows(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """What the border unknowns of each chunk depend on."""
    for batch in batches:
        if batch.num_rows:
            *_, filled, begin, end, x = _local(batch, 1, chunk)
            some = pa.array(np.flatnonzero(filled))
            columns = [*x[:, begin], *x[:, end]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(some), batch.column(1).take(some), *(pa.array(v) for v in columns)], names=[*batch.schema.names[:2], *_BORDER]
            )


def _solve_borders(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Border unknowns of every chunk: one elimination along the chunks, all recordings of a batch together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(size)))
        fields = batch.column(1).flatten().flatten()
        c = fields[0].to_numpy()
        f0, f1, fl, fr, l0, l1, ll, lr = (f.to_numpy(zero_copy_only=False) for f in fields[1:])
        first_p, last_p = np.stack([f0, f1]), np.stack([l0, l1])
        n = len(c)
        lanes = np.argsort(-size, kind="stable")
        start, left = bounds[:-1][lanes], size[lanes]
        live = [start[: np.searchsorted(-left, -j, side="left")] + j for j in range(int(size.max()))]
        # Last unknown of a chunk: base + slope * (first unknown of the next).
        base, slope = np.zeros((2, n)), np.zeros(n)
        first, last = np.zeros((2, n)), np.zeros((2, n))
        for j, at in enumerate(live):
            a, b = (base[:, at - 1], slope[at - 1]) if j else (np.zeros((2, len(at))), np.zeros(len(at)))
            pivot = 1 - fl[at] * b
            const = (first_p[:, at] + fl[at] * a) / pivot
            first[:, at] = const
            base[:, at] = last_p[:, at] + ll[at] * (a + b * const)
            slope[at] = ll[at] * b * fr[at] / pivot + lr[at]
        for j in range(len(live) - 1, -1, -1):
            at = live[j]
            right = np.zeros((2, n))
            follows = live[j + 1] - 1 if j + 1 < len(live) else np.zeros(0, int)
            right[:, follows] = first[:, follows + 1]
            b = slope[at - 1] if j else np.zeros(len(at))
            first[:, at] += fr[at] * right[:, at] / (1 - fl[at] * b)
            last[:, at] = base[:, at] + slope[at] * right[:, at]
        rec = np.repeat(np.arange(len(size)), size)
        heads, tails = np.zeros(n, bool), np.zeros(n, bool)
        heads[bounds[:-1][size > 0]], tails[bounds[1:][size > 0] - 1] = True, True
        before = np.where(heads, 0, np.roll(last, 1, axis=1))
        after = np.where(tails, 0, np.roll(first, -1, axis=1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rec)), pa.array(c), *(pa.array(x) for x in (*before, *after))],
            names=[key, "__c", "left_0", "left_1", "right_0", "right_1"],
        )


def _curvatures(batches: Iterator[pa.RecordBatch], chunk: int, key: str) -> Iterator[pa.RecordBatch]:
    """Every own knot of a chunk with its curvatures."""
    for batch in batches:
        if not batch.num_rows:
            continue
        c, k, t, y, row, own, last, bounds, filled, begin, end, x = _local(batch, 1, chunk)
        sides = [np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False).astype(float)) for i in range(3, 7)]
        left, right = np.stack(sides[:2]), np.stack(sides[2:])
        m = np.zeros((2, len(k)))
        m[:, own] = x[:2] + x[2] * left[:, row[own]] + x[3] * right[:, row[own]]
        # The outermost curvatures follow from their two neighbours.
        before = np.where(np.isin(own, own[begin]) & (k[own] > 1), left[:, row[own]], m[:, own - 1])
        z = own[last]
        hl, hk = t[z + 1] - t[z], t[z] - t[z - 1]
        m[:, z + 1] = ((hl + hk) * m[:, z] - hl * before[:, last]) / hk
        zero = np.flatnonzero((k == 0) & (c[row] == 0))
        sizes = np.bincount(row, minlength=len(c))
        some = zero[sizes[row[zero]] >= 4]
        h0, h1 = t[some + 1] - t[some], t[some + 2] - t[some + 1]
        m[:, some] = ((h0 + h1) * m[:, some + 1] - h0 * m[:, some + 2]) / h1
        three = zero[sizes[row[zero]] == 3]
        h0, h1 = t[three + 1] - t[three], t[three + 2] - t[three + 1]
        bend = 2 * ((y[:, three + 2] - y[:, three + 1]) / h1 - (y[:, three + 1] - y[:, three]) / h0) / (h0 + h1)
        for j in range(3):
            m[:, three + j] = bend
        # The last knot comes from the chunk that holds the one before it.
        keep = (sizes < 4)[row] & (c == 0)[row]
        keep[np.concatenate([own, z + 1, zero])] = True
        at = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row[at])), *(pa.array(v[at]) for v in (k, t, *y, *m))],
            names=[key, "k", "t", "arousal", "valence", "arousal_m", "valence_m"],
        )


def spline(marks: DataFrame, key: str = "video_id", chunk: int = KNOT_CHUNK) -> DataFrame:
    """Knots with the curvatures of the not-a-knot cubic through arousal and valence.

    The tridiagonal system of a recording is solved in chunks of knots: each is
    eliminated down to its first and last unknown, one small elimination along
    the chunks gives those, and the chunks fill in the rest. ``chunk`` is 3 at
    least. Two knots give a line, three a parabola.
    """
    # Each equation reads the knots beside its own; the last ones are told by what follows.
    near = F.array_distinct(F.transform(F.array(*[F.lit(o) for o in (0, 1, -1, -2)]), lambda o: F.floor((F.col("k") + o) / chunk)))
    dealt = marks.select(key, F.explode(near).alias("__c"), F.struct("k", "t", "arousal", "valence").alias("__x")).where("__c >= 0")
    rows = dealt.groupBy(key, "__c").agg(F.sort_array(F.collect_list("__x")).alias("__x"))
    rows = rows.where(F.element_at("__x", -1)["k"] >= F.col("__c") * chunk)
    table = materialize(rows, "knot-chunks")
    kind = T.StructField(key, table.schema[key].dataType)
    number = T.StructField("__c", T.LongType())
    doubles = lambda names: [T.StructField(n, T.DoubleType()) for n in names]
    borders = table.mapInArrow(lambda it: _border_rows(it, chunk), T.StructType([kind, number, *doubles(_BORDER)]))
    along = borders.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__c", *_BORDER))).alias("__b"))
    sides = ("left_0", "left_1", "right_0", "right_1")
    solved = along.mapInArrow(lambda it: _solve_borders(it, key), T.StructType([kind, number, *doubles(sides)]))
    joined = table.join(solved, [key, "__c"], "left").select(key, "__c", "__x", *sides)
    out = T.StructType([kind, T.StructField("k", T.LongType()), *doubles(("t", "arousal", "valence", "arousal_m", "valence_m"))])
    return joined.mapInArrow(lambda it: _curvatures(it, chunk, key), out)


def cubic(points: DataFrame, marks: DataFrame, key: str = "video_id", chunk: int = KNOT_CHUNK) -> DataFrame:
    """Spline values of arousal and valence at each grid point, beyond the ends too."""
    names = ["arousal", "valence"]
    bent = materialize(spline(marks, key, chunk), "splines")
    spans = _ends(points, bent, key, [*names, *[f"{n}_m" for n in names]])
    h, a, b = F.col("t1") - F.col("t0"), F.col("t1") - F.col("t"), F.col("t") - F.col("t0")

    def value(n: str) -> Column:
        m0, m1, y0, y1 = (F.col(f"{n}{x}") for x in ("_m0", "_m1", "0", "1"))
        curve = (m0 * a * a * a + m1 * b * b * b) / (6 * h) + (y0 / h - m0 * h / 6) * a + (y1 / h - m1 * h / 6) * b
        return F.when(F.col("t1").isNull(), y0).otherwise(curve).alias(n)

    return spans.select(key, "g", *[value(n) for n in names])


#: Recordings whose grids are worked on together.
GRIDS = 256


def _grids(values: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row a recording, its grid in order. That is ``points`` entries, however long the recording."""
    return values.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("g", *columns))).alias("__x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Keys of some recordings, row and grid point of their entries, and the entries' columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, GRIDS):
            some = batch.slice(at, GRIDS)
            fields = some.column(1).flatten().flatten()
            row = np.repeat(np.arange(some.num_rows), some.column(1).value_lengths().to_numpy(zero_copy_only=False))
            yield some.column(0), row, fields[0].to_numpy(), fields[1:]


def gaussian(values: DataFrame, columns: list[str], points: int, sigma: float = 3.0, key: str = "video_id") -> DataFrame:
    """Gaussian smoothing along the grid, mirrored at the ends, clipped to [0, 1]."""
    radius = int(4 * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (offsets / sigma) ** 2)
    weights /= weights.sum()

    def run(batches):
        for keys, row, g, fields in _matrices(batches):
            out = []
            for field in fields:
                there = field.is_valid().to_numpy(zero_copy_only=False)
                grid, known = np.zeros((len(keys), points)), np.zeros((len(keys), points), bool)
                grid[row[there], g[there]] = field.drop_null().to_numpy(zero_copy_only=False)
                known[row[there], g[there]] = True
                total, any_known = np.zeros(grid.shape), np.zeros(grid.shape, bool)
                for o, w in zip(offsets, weights):
                    # Mirrored about the half-sample beyond each end.
                    wrapped = np.mod(np.arange(points) + o, 2 * points)
                    source = np.where(wrapped < points, wrapped, 2 * points - 1 - wrapped)
                    total += w * grid[:, source]
                    any_known |= known[:, source]
                # NaN counts as larger than any number.
                clipped = np.where(np.isnan(total), 1.0, np.clip(total, 0.0, 1.0))
                out.append(pa.array(clipped[row, g], mask=~any_known[row, g]))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(g), *out], names=[key, "g", *columns])

    doubles = [T.StructField(c, T.DoubleType()) for c in columns]
    grids = _grids(values.select(key, "g", *[F.col(c).cast("double").alias(c) for c in columns]), columns, key)
    return grids.mapInArrow(run, T.StructType([values.schema[key], values.schema["g"], *doubles]))


def smooth_timeline(rows: DataFrame, points: int = 500, key: str = "video_id", order: str = "segment_id") -> DataFrame:
    """The evenly spaced timeline: smoothed arousal and valence, agreement, emotion."""
    marks = materialize(knots(rows, key, order), "knots")
    placed = materialize(bracket(grid(rows, points, key), marks, key), "grid")
    curves = materialize(cubic(placed, marks, key), "curves")
    smoothed = gaussian(curves, ["arousal", "valence"], points, key=key)
    return linear_and_nearest(placed, marks, key).join(smoothed, [key, "g"])


def label_mix(timeline: DataFrame, points: int, half: int = 15, key: str = "video_id") -> DataFrame:
    """Distance-weighted share of each label around each grid point.

    The first and the last point take their own label alone.
    """

    def run(batches):
        for keys, row, g, (labels,) in _matrices(batches):
            names = labels.unique()
            code = pc.index_in(labels, names).to_numpy()
            own = np.full((len(keys), points), -1)
            own[row, g] = code
            mixed = np.zeros((len(names), len(keys), points))
            for c in range(len(names)):
                marked = (own == c).astype(float)
                for o in range(-half, half):
                    to = slice(max(0, -o), max(0, min(points, points - o)))
                    mixed[c][:, to] += marked[:, to.start + o : to.stop + o] / (1 + abs(o))
            ends = np.unique([0, points - 1])
            mixed[:, :, ends] = own[:, ends] == np.arange(len(names))[:, None, None]
            mixed[:, own < 0] = 0
            total = mixed.sum(axis=0)
            c, r, g = np.nonzero(mixed)
            share = mixed[c, r, g] / total[r, g]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), pa.array(g.astype(np.int32)), names.take(pa.array(c)), pa.array(share)], names=[key, "g", "emotion_id", "share"])

    fields = [timeline.schema[key], T.StructField("g", T.IntegerType()), timeline.schema["emotion_id"], T.StructField("share", T.DoubleType())]
    return _grids(timeline, ["emotion_id"], key).mapInArrow(run, T.StructType(fields))
