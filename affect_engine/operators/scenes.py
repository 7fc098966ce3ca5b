"""Shots to scenes, words to scenes, and the checks on both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .greedy import CHUNK_ITEMS, Extent, follow
from .scan import chunk_of, exact_quantiles, ordered_scan

SHOT_CHUNK = CHUNK_ITEMS
TIME_CHUNK = 3600.0


def global_scenes(
    shots: DataFrame, max_duration: float = 900.0, min_gap: float = 5.0, key: str = "video_id"
) -> DataFrame:
    """Merge shots into scenes.

    A scene grows until the next shot would end more than ``max_duration`` after
    the scene's start, or starts more than ``min_gap`` after the end of the shot
    before it. Shots are numbered 0, 1, ... per recording; their times may be in
    any order.
    """
    rule = Extent("start", "end", max_duration, min_gap)
    placed = follow(shots, [key], "scene_id", rule, "__scene", ["start", "end"], chunk=SHOT_CHUNK)
    scenes = placed.groupBy(key, "__scene").agg(
        F.min_by("start", "scene_id").alias("start"),
        F.max_by("end", "scene_id").alias("end"),
        F.count(F.lit(1)).alias("shot_count"),
        F.min("scene_id").alias("first_shot"),
        F.max("scene_id").alias("last_shot"),
    )
    numbered = ordered_scan(
        materialize(scenes, "scenes"), [key], ["__scene"], chunk_of(F.col("__scene"), SHOT_CHUNK), position="__pos"
    )
    return numbered.select(
        key,
        (F.col("__pos") - 1).alias("global_scene_id"),
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("duration"),
        "shot_count",
        "first_shot",
        "last_shot",
    )


def words_to_scenes(words: DataFrame, scenes: DataFrame, key: str = "video_id") -> DataFrame:
    """Each word with the scene that contains its start, if any.

    Scenes are disjoint, so the only candidate is the last scene to start at
    or before the word: an as-of join along the time line, without a range
    join.
    """
    order = ["start", "__kind", "__tie"]
    # What places a word travels once.
    tie = ["segment_id", "i"]
    rest = [c for c in words.columns if c not in (key, "start", *tie)]
    line = words.select(
        key,
        "start",
        F.lit(1).alias("__kind"),
        F.struct(*tie).alias("__tie"),
        F.struct(*(rest or [key])).alias("__word"),
        F.lit(None).cast("struct<id:bigint,end:double>").alias("__scene"),
    ).unionByName(
        scenes.select(
            key,
            "start",
            F.lit(0).alias("__kind"),
            F.struct(
                F.col("global_scene_id").alias("segment_id"), F.lit(0).cast("long").alias("i")
            ).alias("__tie"),
            F.struct(F.col("global_scene_id").cast("long").alias("id"), "end").alias("__scene"),
        ),
        allowMissingColumns=True,
    )
    seen = ordered_scan(
        line, [key], order, chunk_of(F.col("start"), TIME_CHUNK), carry={"__last": F.col("__scene")}
    ).where("__kind = 1")
    inside = F.col("start") < F.col("__last.end")
    kept = {c: F.col(f"__tie.{c}").cast(words.schema[c].dataType) for c in tie} | {c: F.col(f"__word.{c}") for c in rest}
    own = [kept.get(c, F.col(c)).alias(c) for c in words.columns]
    return seen.select(*own, F.when(inside, F.col("__last.id")).alias("global_scene_id"))


def words_to_scenes_by_range(
    words: DataFrame, scenes: DataFrame, width: float, key: str = "video_id"
) -> DataFrame:
    """The same join for scenes that may overlap: equi-join on time buckets."""
    buckets = scenes.select(
        key,
        "global_scene_id",
        F.col("start").alias("__from"),
        F.col("end").alias("__to"),
        F.explode(
            F.sequence(chunk_of(F.col("start"), width), chunk_of(F.col("end"), width))
        ).alias("__b"),
    )
    return (
        words.withColumn("__b", chunk_of(F.col("start"), width))
        .join(buckets, [key, "__b"])
        .where((F.col("__from") <= F.col("start")) & (F.col("start") < F.col("__to")))
        .select(*words.columns, "global_scene_id")
    )


def _kept(*messages: Column) -> Column:
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def shot_problems(
    shots: DataFrame, durations: DataFrame | None = None, key: str = "video_id"
) -> DataFrame:
    """Late first shot, gaps, overlaps, wrong durations, end far from the video's."""
    seen = ordered_scan(
        shots,
        [key],
        ["scene_id"],
        chunk_of(F.col("scene_id"), SHOT_CHUNK),
        position="__pos",
        leads={"__next": F.col("start")},
    )
    if durations is not None:
        seen = seen.join(durations.select(key, "video_duration"), key, "left")
    else:
        seen = seen.withColumn("video_duration", F.lit(0.0))
    has_next, last = F.col("__next").isNotNull(), F.col("__next").isNull()
    off = F.abs(F.col("end") - F.col("start") - F.col("duration"))
    return seen.select(
        key,
        "scene_id",
        F.explode(
            _kept(
                F.when((F.col("__pos") == 1) & (F.abs("start") > 0.01), "late_start"),
                F.when(has_next & (F.abs(F.col("__next") - F.col("end")) > 0.1), "gap"),
                F.when(has_next & (F.col("end") > F.col("__next")), "overlap"),
                F.when(has_next & (off > 0.01), "duration_mismatch"),
                F.when(
                    last
                    & (F.col("video_duration") > 0)
                    & (F.abs(F.col("end") - F.col("video_duration")) > 1.0),
                    "end_mismatch",
                ),
            )
        ).alias("problem"),
    )


def scene_problems(scenes: DataFrame, key: str = "video_id") -> DataFrame:
    """Late first scene, gaps over a second, overlaps, wrong durations."""
    seen = ordered_scan(
        scenes,
        [key],
        ["global_scene_id"],
        chunk_of(F.col("global_scene_id"), SHOT_CHUNK),
        position="__pos",
        leads={"__next": F.col("start")},
    )
    has_next = F.col("__next").isNotNull()
    off = F.abs(F.col("end") - F.col("start") - F.col("duration"))
    return seen.select(
        key,
        "global_scene_id",
        F.explode(
            _kept(
                F.when((F.col("__pos") == 1) & (F.col("start") > 5.0), "late_start"),
                F.when(has_next & (F.abs(F.col("__next") - F.col("end")) > 1.0), "gap"),
                F.when(has_next & (F.col("end") > F.col("__next")), "overlap"),
                F.when(has_next & (off > 0.1), "duration_mismatch"),
            )
        ).alias("problem"),
    )


def segment_problems(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Word-count limits, empty speech, wrong durations, gaps over five seconds."""
    seen = ordered_scan(
        segments,
        [key],
        ["segment_id"],
        chunk_of(F.col("segment_id"), SHOT_CHUNK),
        leads={"__next": F.col("start")},
    )
    speech, count = F.col("has_speech"), F.col("word_count")
    off = F.abs(F.col("end") - F.col("start") - F.col("duration"))
    return seen.select(
        key,
        "segment_id",
        F.explode(
            _kept(
                F.when(speech & (count < 8), "too_short"),
                F.when(count > 60, "too_long"),
                F.when(speech & (count == 0), "speech_without_words"),
                F.when(speech & (F.col("text") == ""), "speech_without_text"),
                F.when(off > 0.1, "duration_mismatch"),
                F.when(F.col("__next") - F.col("end") > 5.0, "gap"),
            )
        ).alias("problem"),
    )


def duration_statistics(
    df: DataFrame, keys: Sequence[str], duration: str = "duration"
) -> DataFrame:
    """Count, mean, median, extremes and total of a duration per group."""
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(duration).alias("average"),
        F.min(duration).alias("shortest"),
        F.max(duration).alias("longest"),
        F.sum(duration).alias("total"),
    )
    middle = exact_quantiles(df, keys, duration, {"median": 0.5})
    return plain.join(middle, list(keys))


def reduction_ratio(shots: DataFrame, scenes: DataFrame, key: str = "video_id") -> DataFrame:
    a = shots.groupBy(key).agg(F.count(F.lit(1)).alias("shots"))
    b = scenes.groupBy(key).agg(F.count(F.lit(1)).alias("scenes"))
    return a.join(b, key).withColumn("reduction", F.col("shots") / F.col("scenes"))
