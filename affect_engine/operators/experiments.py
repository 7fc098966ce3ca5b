"""Experiment records: append, latest, best, report, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import chunk_of, ordered_scan


def append_records(log: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Append rows with ids that continue after the largest one."""
    top = log.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    numbered = ordered_scan(new, [], [order], chunk_of(F.col(order), 65536), position="__pos")
    # One row.
    placed = numbered.join(F.broadcast(top), how="cross").withColumn(key, F.col("__top") + F.col("__pos"))
    return log.unionByName(placed.select(log.columns))


def set_difference(got: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """Values expected but unseen, and seen but unexpected."""
    seen = got.select(column).distinct()
    unseen = expected.select(column).join(seen, column, "left_anti").withColumn("kind", F.lit("unseen"))
    extra = seen.join(expected.select(column), column, "left_anti").withColumn("kind", F.lit("unexpected"))
    return unseen.unionByName(extra)


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The record with the largest ``order`` of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def best(df: DataFrame, score: str, n: int, tie: str, ascending: bool = False) -> DataFrame:
    """The n best rows; NaN counts as worst."""
    value = F.nanvl(F.col(score), F.lit(None).cast("double"))
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return df.orderBy(order, tie).limit(n)


def best_per(df: DataFrame, key: str, score: Column, tie: str) -> DataFrame:
    """The best row per key, NaN and null below every real score."""
    real = F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(-1.0))
    rest = [c for c in df.columns if c != key]
    order = F.struct(real.alias("s"), (-F.col(tie)).alias("t"))
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def report(df: DataFrame, key: str, order: str, score: str, threshold: float = 0.75) -> DataFrame:
    """Headline figures over the latest record of every model."""
    last = latest_per(df, key, order)
    ranking = F.struct(score, key)
    return last.agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count_if(F.col(score) >= threshold).alias("models_above_threshold"),
        F.max_by(key, ranking).alias("best_model"),
        F.min_by(key, ranking).alias("worst_model"),
        F.max(score).alias("best_score"),
        F.avg(score).alias("average_score"),
    )


def best_by_type(df: DataFrame, key: str, order: str, kind: str, score: str) -> DataFrame:
    return latest_per(df, key, order).groupBy(kind).agg(F.max(score).alias("best_score"))


def winner(df: DataFrame, run: str, loss: str) -> DataFrame:
    """Which of the runs reaches the lower loss and by how many percent."""
    lows = df.groupBy(run).agg(F.min(loss).alias("low"))
    return lows.agg(
        F.min_by(run, "low").alias("winner"),
        F.min("low").alias("best_loss"),
        (F.try_divide(F.max("low") - F.min("low"), F.max("low")) * 100).alias("improvement"),
    )
