"""Loudness, silence and quality flags over audio samples and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import RANGE, by_ranges, chunk_of, ordered_scan

FRAME_CHUNK = 16384


def rms_db(rms: Column, floor: float = -100.0) -> Column:
    """Level in decibels; practically silent input gets the floor."""
    return F.when(rms < 1e-10, F.lit(floor)).otherwise(20 * F.log10(rms))


def frame_rms(samples: DataFrame, frame: int, key: str = "track") -> DataFrame:
    """RMS of non-overlapping frames; an incomplete last frame is left out."""
    return (
        samples.groupBy(key, F.floor(F.col("i") / frame).cast("long").alias("frame"))
        .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") == frame)
        .drop("__n")
    )


def track_levels(samples: DataFrame, key: str = "track") -> DataFrame:
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    return samples.groupBy(key).agg(
        rms_db(rms).alias("level_db"),
        F.max(F.abs("x")).alias("peak"),
        F.avg("x").alias("mean"),
    )


def normalization_gain(levels: DataFrame, target_db: float = -12.0, ceiling: float = 0.99) -> DataFrame:
    """Linear gain to the target level, lowered so the peak stays under the ceiling."""
    gain = F.pow(F.lit(10.0), (F.lit(target_db) - F.col("level_db")) / 20)
    loud = F.col("peak") * gain
    return levels.withColumn(
        "gain", F.when(loud > ceiling, gain * ceiling / loud).otherwise(gain)
    )


def silence_regions(
    frames: DataFrame,
    threshold: float,
    hop: float,
    min_duration: float = 0.3,
    key: str = "track",
) -> DataFrame:
    """Runs of quiet frames of at least ``min_duration`` seconds.

    Gaps and islands: quiet frames share an island number, the count of loud
    frames before them. A run ends where the next frame starts.
    """
    quiet = (F.col("rms") < threshold).cast("int")
    seen = ordered_scan(
        frames.select(key, "i", quiet.alias("__quiet")),
        [key],
        ["i"],
        chunk_of(F.col("i"), FRAME_CHUNK),
        sums={"__island": 1 - F.col("__quiet")},
    )
    runs = (
        seen.where("__quiet = 1")
        .groupBy(key, "__island")
        .agg((F.min("i") * hop).alias("start"), ((F.max("i") + 1) * hop).alias("end"))
    )
    return runs.where(F.col("end") - F.col("start") >= min_duration - 1e-9).drop("__island")


def signal_to_noise(frames: DataFrame, key: str = "track") -> DataFrame:
    """Ratio of the frame levels at positions int(.9 n) and n // 10, in decibels.

    Null up to ten frames or when the quiet level is practically zero.
    """
    counts = frames.groupBy(key, "rms").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_scan(
        by_ranges(counts, [key, "rms"], "level-counts"), [key], ["rms"], F.col(RANGE), sums={"below": F.col("n")}
    )
    totals = frames.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    located = ranked.join(totals, key)

    def at(index: Column) -> Column:
        inside = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
        return F.max(F.when(inside, F.col("rms")))

    picks = located.groupBy(key, "total").agg(
        at(F.floor(F.col("total") / 10)).alias("noise"),
        at(F.floor(F.col("total") * 0.9)).alias("signal"),
    )
    usable = (F.col("total") > 10) & (F.col("noise") > 1e-10) & (F.col("signal") > F.col("noise"))
    ratio = F.try_divide("signal", "noise")
    return picks.select(key, F.when(usable, 20 * F.log10(ratio)).alias("snr_db"))


def quality_flags(levels: DataFrame, snr: DataFrame, key: str = "track") -> DataFrame:
    flags = F.filter(
        F.array(
            F.when(F.col("peak") > 0.99, "clipping"),
            F.when(F.abs("mean") > 0.01, "dc_offset"),
            F.when(F.col("level_db") < -40, "too_quiet"),
            F.when(F.col("snr_db") < 20, "low_snr"),
        ),
        lambda f: f.isNotNull(),
    )
    return levels.join(snr, key, "left").select(key, flags.alias("flags"))
