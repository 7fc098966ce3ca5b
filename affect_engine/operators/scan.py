"""Ordered operators that stay parallel inside one hot group.

A plain ``Window.partitionBy(video_id)`` sends a whole recording to one task.
``ordered_scan`` splits every group into order-preserving chunks, runs the
window per ``(group, chunk)`` and carries the small per-chunk summary across.
The big side is shuffled once, on ``(group, chunk)``; the summary is reduced
map-side and holds one row per chunk.

``chunk`` must never decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_CHUNK = "__chunk"
_GLOBAL = "__all"


def chunk_of(column: Column, width: float) -> Column:
    """Order-preserving chunk number of a numeric column."""
    return F.floor(column / F.lit(width)).cast("long")


def nested_chunk(major: Column, minor: Column, width: int) -> Column:
    """Chunk along two whole-number order columns: one per ``major`` value and
    ``width`` steps of ``minor``, so that neither can pile up in one chunk."""
    return (major * (1 << 24) + F.floor(minor / width)).cast("long")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    carry: Mapping[str, Column] | None = None,
    highs: Mapping[str, Column] | None = None,
    prior: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add order-dependent columns within ``keys``, ascending by ``order``.

    position  1-based row number
    sums      sum over all earlier rows (0 for the first)
    lags      value of the previous row
    leads     value of the next row
    carry     last non-null value up to and including the row
    highs     running maximum up to and including the row
    prior     last non-null value before the row
    """
    sums, lags, leads = dict(sums or {}), dict(lags or {}), dict(leads or {})
    carry, highs, prior = dict(carry or {}), dict(highs or {}), dict(prior or {})
    group = list(keys)
    base = df.withColumn(_CHUNK, chunk)
    if not group:
        base, group = base.withColumn(_GLOBAL, F.lit(0)), [_GLOBAL]

    inner = Window.partitionBy(*group, _CHUNK).orderBy(*[F.col(c).asc() for c in order])
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*[F.col(c) for c in order])

    local, summary = [], []
    if position:
        local.append(F.row_number().over(inner).cast("long").alias("__l_pos"))
        summary.append(F.count(F.lit(1)).alias("__t_pos"))
    for name, value in sums.items():
        local.append(F.sum(value).over(before).alias(f"__l_{name}"))
        summary.append(F.sum(value).alias(f"__t_{name}"))
    for name, value in lags.items():
        local.append(F.lag(F.struct(value.alias("v"))).over(inner).alias(f"__l_{name}"))
        summary.append(F.max_by(F.struct(value.alias("v")), rank).alias(f"__t_{name}"))
    for name, value in leads.items():
        local.append(F.lead(F.struct(value.alias("v"))).over(inner).alias(f"__l_{name}"))
        summary.append(F.min_by(F.struct(value.alias("v")), rank).alias(f"__t_{name}"))
    for name, value in (carry | prior).items():
        reach = upto if name in carry else before
        local.append(F.last(value, ignorenulls=True).over(reach).alias(f"__l_{name}"))
        summary.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(f"__t_{name}"))
    for name, value in highs.items():
        local.append(F.max(value).over(upto).alias(f"__l_{name}"))
        summary.append(F.max(value).alias(f"__t_{name}"))

    outer = Window.partitionBy(*group).orderBy(_CHUNK)
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy(*group, _CHUNK).agg(*summary)
    carried = []
    if position:
        carried.append(F.sum("__t_pos").over(earlier).alias("__o_pos"))
    carried += [F.sum(f"__t_{n}").over(earlier).alias(f"__o_{n}") for n in sums]
    carried += [F.lag(f"__t_{n}").over(outer).alias(f"__o_{n}") for n in lags]
    carried += [F.lead(f"__t_{n}").over(outer).alias(f"__o_{n}") for n in leads]
    carried += [F.last(f"__t_{n}", ignorenulls=True).over(earlier).alias(f"__o_{n}") for n in (*carry, *prior)]
    carried += [F.max(f"__t_{n}").over(earlier).alias(f"__o_{n}") for n in highs]
    offsets = offsets.select(*group, _CHUNK, *carried)

    joined = base.select("*", *local).join(offsets, [*group, _CHUNK], "left")
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.col("__l_pos") + F.coalesce("__o_pos", F.lit(0))).alias(position))
    for name in sums:
        zero = F.lit(0)
        out.append(
            (F.coalesce(f"__l_{name}", zero) + F.coalesce(f"__o_{name}", zero)).alias(name)
        )
    for name in (*lags, *leads):
        out.append(F.coalesce(f"__l_{name}", f"__o_{name}")["v"].alias(name))
    for name in (*carry, *prior):
        out.append(F.coalesce(f"__l_{name}", f"__o_{name}").alias(name))
    for name in highs:
        out.append(F.greatest(f"__l_{name}", f"__o_{name}").alias(name))
    return joined.select(*out)


RANGE = "__range"


def by_ranges(df: DataFrame, order: Sequence[str], name: str = "ranges") -> DataFrame:
    """``df`` in ranges of ``order`` of about equal size, numbered in ``RANGE``.

    Spark samples the rows for the borders, so values that lie close together
    are spread like any others. The rows are written once, as another run might
    draw other borders.
    """
    dealt = df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id())
    return materialize(dealt, name)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, chunk: Column | None = None) -> DataFrame:
    """One row per distinct value: its count, rows below it, and its mean rank.

    Equal values are merged map-side first, so ties cost nothing and the result
    feeds percent ranks, quantiles, AUC and rank correlation alike. Values are
    dealt in ranges drawn from themselves, unless ``chunk`` names others.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    if chunk is None:
        counts, chunk = by_ranges(counts, [*keys, value], "value-counts"), F.col(RANGE)
    ranked = ordered_scan(counts, keys, [value], chunk, sums={"n_below": F.col("n_equal")}).drop(RANGE)
    return ranked.withColumn("mean_rank", F.col("n_below") + (F.col("n_equal") + 1) / 2)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    chunk: Column | None = None,
) -> DataFrame:
    """Exact linear quantiles per group, without holding a group in one task."""
    group = list(keys)
    if not group:
        df, group = df.withColumn(_GLOBAL, F.lit(0)), [_GLOBAL]
    found = quantiles_of_ranks(value_ranks(df, group, value, chunk), group, value, probabilities)
    return found.select(*keys, *probabilities)


def quantiles_of_ranks(
    ranks: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Quantiles read off a table made by ``value_ranks``."""
    totals = ranks.groupBy(*keys).agg(F.sum("n_equal").alias("__n"))
    located = ranks.join(totals, list(keys))
    picks = []
    for name, p in probabilities.items():
        target = F.lit(float(p)) * (F.col("__n") - 1)
        for side, index in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            inside = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n_equal"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"__{name}_{side}"))
    found = located.groupBy(*keys, "__n").agg(*picks)
    out = []
    for name, p in probabilities.items():
        target = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (target - F.floor(target))).alias(name))
    return found.select(*keys, *out)
