"""Checks, flags, statistics and selection over transcripts and downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import literal_map
from ..functions.vocab import TRANSCRIPT_MODEL_RANK
from .scan import chunk_of, ordered_scan


def _kept(*messages: Column) -> Column:
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def quality_flags(
    no_speech: Column, avg_logprob: Column, compression: Column, n_words: Column
) -> Column:
    """Names of the quality rules a transcript segment breaks."""
    return _kept(
        F.when(F.coalesce(no_speech, F.lit(0.0)) > 0.6, "likely_silence"),
        F.when(F.coalesce(avg_logprob, F.lit(0.0)) < -0.5, "low_confidence"),
        F.when(F.coalesce(compression, F.lit(1.0)) > 2.4, "possible_repetition"),
        F.when(F.coalesce(n_words, F.lit(0)) == 0, "no_word_timestamps"),
    )


def download_issues(video_mb: Column, audio_mb: Column, duration: Column) -> Column:
    """Sizes below a tenth of a megabyte, and totals far below the expected."""
    expected = F.coalesce(duration, F.lit(0.0)) / 60 * 15
    return _kept(
        F.when(video_mb < 0.1, "video_too_small"),
        F.when(audio_mb < 0.1, "audio_too_small"),
        F.when((duration > 0) & (video_mb + audio_mb < expected / 10), "truncated"),
    )


def transcript_statistics(segments: DataFrame, words: DataFrame, key: str = "video_id") -> DataFrame:
    """Totals, mean word probability and counts of doubtful segments."""
    a = segments.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(F.coalesce("avg_logprob", F.lit(0.0)) < -0.5).alias("low_confidence_segments"),
        F.count_if(F.coalesce("compression_ratio", F.lit(1.0)) > 2.4).alias(
            "high_compression_segments"
        ),
        F.count_if(F.coalesce("no_speech_prob", F.lit(0.0)) > 0.6).alias("high_no_speech_segments"),
    )
    b = words.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_words"), F.avg("probability").alias("average_confidence")
    )
    return a.join(b, key, "left").select(
        *a.columns,
        F.coalesce("total_words", F.lit(0)).alias("total_words"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
    )


def transcript_problems(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Missing fields, negative or reversed times, overlap with the segment before."""
    seen = ordered_scan(
        segments,
        [key],
        ["segment_id"],
        chunk_of(F.col("segment_id"), 4096),
        lags={"__prev": F.coalesce("end", F.lit(0.0))},
    )
    start, end = F.coalesce("start", F.lit(0.0)), F.coalesce("end", F.lit(0.0))
    return seen.select(
        key,
        "segment_id",
        F.explode(
            _kept(
                *[F.when(F.col(c).isNull(), f"missing_{c}") for c in ("start", "end", "text")],
                F.when(start < 0, "negative_start"),
                F.when(end < start, "reversed"),
                F.when(start < F.col("__prev") - 0.1, "overlaps_previous"),
            )
        ).alias("problem"),
    )


def word_problems(words: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Words outside their segment, and words overlapping the one before."""
    bounds = segments.select(
        key, "segment_id", F.col("start").alias("__from"), F.col("end").alias("__to")
    )
    seen = ordered_scan(
        words,
        [key, "segment_id"],
        ["i"],
        chunk_of(F.col("i"), 4096),
        lags={"__prev": F.col("end")},
    ).join(bounds, [key, "segment_id"])
    outside = (F.col("start") < F.col("__from") - 0.1) | (F.col("end") > F.col("__to") + 0.1)
    return seen.select(
        key,
        "segment_id",
        "i",
        F.explode(
            _kept(
                F.when(outside, "outside_segment"),
                F.when(F.col("start") < F.col("__prev") - 0.01, "overlaps_previous"),
            )
        ).alias("problem"),
    )


def best_transcription(df: DataFrame, key: str = "video_id", tie: str = "path") -> DataFrame:
    """One transcription per recording: full, newest, best model, longest."""
    rank = F.coalesce(literal_map(TRANSCRIPT_MODEL_RANK)[F.col("model")], F.lit(0))
    order = F.struct(
        (F.col("duration_limit") == "full").alias("full"),
        F.col("transcription_date").alias("date"),
        rank.alias("rank"),
        F.col("duration").alias("duration"),
        F.col(tie).alias("tie"),
    )
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("best")).select(
        key, "best.*"
    )


def preferred_model(df: DataFrame, key: str, model: str, preferred: str) -> DataFrame:
    """One artefact per recording: the preferred model's, else the first by name."""
    order = F.struct((F.col(model) != preferred).alias("other"), F.col(model).alias("name"))
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("pick")).select(key, "pick.*")
