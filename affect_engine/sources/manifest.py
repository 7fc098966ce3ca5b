"""Which stage outputs exist already, and with which settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_hash(*settings: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(s.cast("string"), F.lit("")) for s in settings]))


def pending(inputs: DataFrame, manifest: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Inputs without an output of the same stage, model, settings and threshold."""
    done = manifest.select(
        F.col("video_id").alias("__v"), F.col("stage").alias("__s"), F.col("model").alias("__m"),
        F.col("config").alias("__c"), F.col("threshold").alias("__t"),
    )
    same = (
        (F.col("video_id") == F.col("__v"))
        & (F.col("stage") == F.col("__s"))
        & (F.col("model") == F.col("__m"))
        & (F.col("config") == F.col("__c"))
        & (F.abs(F.col("threshold") - F.col("__t")) <= tolerance)
    )
    return inputs.join(done, same, "left_anti")


def status_tally(results: DataFrame) -> DataFrame:
    return results.groupBy("stage").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "failed")]
    )


def outcome_per_recording(results: DataFrame) -> DataFrame:
    """Stages run per recording, whether all succeeded, and the first failed stage."""
    bad = F.col("status") == "failed"
    return results.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("stages"),
        F.count_if(bad).alias("failures"),
        F.min(F.when(bad, F.col("stage"))).alias("first_failure"),
    )
