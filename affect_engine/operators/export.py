"""The export table of a recording and the summaries read from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical_or_null, canonicalize, display
from ..functions.vocab import EMOTION_CLASSES
from .ensemble import export_vote

EXPORT_COLUMNS = (
    "segment_id",
    "start_time",
    "end_time",
    "duration",
    "text_ru",
    "text_en",
    "ru_arousal",
    "ru_valence",
    "en_arousal",
    "en_valence",
    "emotion_ru",
    "emotion_ru_confidence",
    "emotion_en_distil",
    "emotion_en_distil_confidence",
    "emotion_en_deberta",
    "emotion_en_deberta_confidence",
    "emotion_final",
    "emotion_agreement",
)


def align_stages(
    base: DataFrame, keys: Sequence[str], others: Mapping[str, DataFrame]
) -> DataFrame:
    """Left-join several stage outputs to the base segments on one key.

    All sides share the key, so Spark shuffles each of them once and joins the
    rest in place. Columns of a side get its name as prefix.
    """
    out = base
    for name, side in others.items():
        renamed = side.select(
            *keys, *[F.col(c).alias(f"{name}_{c}") for c in side.columns if c not in keys]
        )
        out = out.join(renamed, list(keys), "left")
    return out


def shown(label: Column) -> Column:
    """Display name of a model's label, empty when the model is absent."""
    return F.when(label.isNotNull(), display(label)).otherwise("")


def export_table(aligned: DataFrame) -> DataFrame:
    """The 18 export columns plus ``video_id`` from aligned stage outputs."""
    named = aligned.select(
        "video_id",
        "segment_id",
        F.coalesce("start", F.lit(0.0)).alias("start_time"),
        F.coalesce("end", F.lit(0.0)).alias("end_time"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"),
        F.trim(F.coalesce("text", F.lit(""))).alias("text_ru"),
        F.trim(F.coalesce("text_en", F.lit(""))).alias("text_en"),
        "ru_arousal",
        "ru_valence",
        "en_arousal",
        "en_valence",
        shown(F.col("ru_label")).alias("ru_label"),
        "ru_confidence",
        shown(F.col("distil_label")).alias("distil_label"),
        "distil_confidence",
        shown(F.col("deberta_label")).alias("deberta_label"),
        "deberta_confidence",
    )
    voted = export_vote(named).withColumn("emotion_final", display(F.col("emotion_final")))
    renames = {
        "ru_label": "emotion_ru",
        "ru_confidence": "emotion_ru_confidence",
        "distil_label": "emotion_en_distil",
        "distil_confidence": "emotion_en_distil_confidence",
        "deberta_label": "emotion_en_deberta",
        "deberta_confidence": "emotion_en_deberta_confidence",
    }
    return voted.withColumnsRenamed(renames).select("video_id", *EXPORT_COLUMNS)


def completeness(export: DataFrame) -> DataFrame:
    """Per recording: rows, complete rows and their share in percent."""
    filled = F.lit(True)
    for c in ("text_ru", "text_en", "emotion_ru", "emotion_en_distil", "emotion_en_deberta"):
        filled = filled & (F.coalesce(F.col(c), F.lit("")) != "")
    return (
        export.groupBy("video_id")
        .agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(filled).alias("complete_rows"))
        .withColumn(
            "complete_percentage", F.bround(F.col("complete_rows") * 100.0 / F.col("total_rows"), 1)
        )
    )


def agreement_counts(export: DataFrame) -> DataFrame:
    """Rows of each agreement level per recording, and their share in percent."""
    counts = export.groupBy("video_id", "emotion_agreement").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("video_id").agg(F.sum("n").alias("__all"))
    share = F.bround(F.col("n") * 100.0 / F.col("__all"), 1).alias("percentage")
    return counts.join(totals, "video_id").select("video_id", "emotion_agreement", "n", share)


def ranked_emotions(export: DataFrame, emotion: str = "emotion_final") -> DataFrame:
    """Canonical emotions by falling count, at most one row a class."""
    named = export.select(canonical_or_null(F.col(emotion)).alias("emotion")).where("emotion is not null")
    counts = named.groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "emotion")))


def first_page(rows: DataFrame, order: list[str], size: int = 25) -> DataFrame:
    """The first ``size`` rows in an order; a list view's page."""
    return rows.orderBy(*order).limit(size)


def read_back(export: DataFrame) -> DataFrame:
    """Canonical labels beside the raw ones, numbers parsed, gaps filled."""
    number = {c: F.expr(f"try_cast(nullif(cast({c} as string), '') as double)") for c in (
        "start_time", "end_time", "duration", "ru_arousal", "ru_valence", "en_arousal",
        "en_valence", "emotion_en_deberta_confidence",
    )}
    out = [
        "video_id",
        "segment_id",
        F.coalesce(number["start_time"], F.lit(0.0)).alias("start_time"),
        F.coalesce(number["end_time"], F.lit(0.0)).alias("end_time"),
        number["duration"].alias("duration"),
        *[number[c].alias(c) for c in ("ru_arousal", "ru_valence", "en_arousal", "en_valence")],
        number["emotion_en_deberta_confidence"].alias("confidence"),
        F.coalesce("text_ru", F.lit("")).alias("text_ru"),
        F.coalesce("text_en", F.lit("")).alias("text_en"),
        F.coalesce(F.expr("nullif(emotion_agreement, '')"), F.lit("unknown")).alias("agreement"),
    ]
    for c in ("emotion_ru", "emotion_en_distil", "emotion_en_deberta", "emotion_final"):
        raw = F.coalesce(F.col(c), F.lit(""))
        out += [raw.alias(f"{c}_raw"), canonicalize(raw, default=F.lit("")).alias(c)]
    return export.select(*out)


def run_summary(rows: DataFrame) -> DataFrame:
    """Segments, length, neutral share and the two count maps per recording.

    Counts are reduced per label before they become maps, so a map never holds
    more than the label set.
    """
    long = rows.select(
        "video_id",
        F.inline(
            F.array(
                F.struct(F.lit("agreement").alias("kind"), F.col("agreement").alias("name")),
                F.struct(F.lit("emotion").alias("kind"), F.col("emotion_final").alias("name")),
            )
        ),
    )
    counts = long.where("name <> ''").groupBy("video_id", "kind", "name").agg(
        F.count(F.lit(1)).alias("n")
    )
    entry = F.struct("name", "n")
    maps = counts.groupBy("video_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "agreement", entry))).alias(
            "agreement"
        ),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == "emotion", entry))).alias(
            "emotions"
        ),
    )
    labelled = F.col("emotion_final") != ""
    head = rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.max("end_time").alias("duration_seconds"),
        F.coalesce(
            F.try_divide(
                F.count_if(F.col("emotion_final") == "neutral").cast("double"), F.count_if(labelled)
            ),
            F.lit(0.0),
        ).alias("neutral_share"),
    )
    return head.join(maps, "video_id", "left")


def per_model_counts(rows: DataFrame, models: Mapping[str, str]) -> DataFrame:
    """Label distribution per model with every class present, zero-filled."""
    long = rows.select(
        "video_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), F.col(c).alias("label"))
                    for m, c in models.items()
                ]
            )
        ),
    )
    return long.groupBy("video_id", "model").agg(
        *[F.count_if(F.col("label") == c).alias(c) for c in EMOTION_CLASSES]
    )


def search(rows: DataFrame, emotion=None, agreement=None, text=None) -> DataFrame:
    """Rows matching every given filter; text looks in both languages."""
    if emotion is not None:
        rows = rows.where(F.col("emotion_final") == emotion)
    if agreement is not None:
        rows = rows.where(F.col("agreement") == agreement)
    if text is not None:
        both = F.lower(F.concat_ws(" ", "text_ru", "text_en"))
        rows = rows.where(F.contains(both, F.lit(text.lower())))
    return rows


def label_differs(raw: Column, canonical: Column) -> Column:
    """The model's own label is neither its class nor its display name."""
    low = F.lower(raw)
    return (low != canonical) & (low != F.lower(display(canonical)))
