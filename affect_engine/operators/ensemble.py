"""Votes over several models' labels, and the quality figures built on them.

Votes work on a short array of predictions per row, so no shuffle is needed and
any number of models fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import timeline_label, vote_label
from ..functions.text import let
from .scan import ordered_scan

TIMELINE_MODELS = ("distil", "deberta", "ru")
EXPORT_MODELS = ("ru", "distil", "deberta")


def _prediction(label: Column, known: Column, confidence: Column) -> Column:
    return F.struct(
        label.alias("label"),
        known.alias("known"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
    )


def _present(items: Sequence[Column]) -> Column:
    return F.filter(F.array(*items), lambda p: p.isNotNull())


def _votes(used: Column) -> Column:
    return F.transform(
        used, lambda p: F.size(F.filter(used, lambda q: q["label"] == p["label"]))
    )


def _first_with(used: Column, values: Column, best: Column) -> Column:
    return F.get(used, (F.array_position(values, best) - 1).cast("int"))["label"]


def _most_confident(used: Column) -> Column:
    confidences = F.transform(used, lambda p: p["confidence"])
    return _first_with(used, confidences, F.array_max(confidences))


def _settle(used: Column) -> Column:
    """The whole timeline decision over the usable predictions of one row."""

    def decide(votes: Column) -> Column:
        return let(
            F.struct(F.array_max(votes).alias("top"), F.size(used).alias("n")),
            lambda c: F.struct(
                c["top"].alias("agree"),
                c["n"].alias("total"),
                F.when((c["top"] == c["n"]) & (c["n"] > 1), "full")
                .when(c["top"] * 2 >= c["n"], "majority")
                .otherwise("disagreement")
                .alias("level"),
                F.when(c["top"] * 2 >= c["n"], _first_with(used, votes, c["top"]))
                .otherwise(_most_confident(used))
                .alias("emotion"),
            ),
        )

    def finish(d: Column) -> Column:
        agreeing = F.filter(used, lambda p: p["label"] == d["emotion"])
        return F.struct(
            d["emotion"].alias("emotion"),
            d["level"].alias("agreement_level"),
            d["agree"].alias("models_agree"),
            d["total"].alias("total_models"),
            let(
                agreeing,
                lambda a: F.aggregate(a, F.lit(0.0), lambda s, p: s + p["confidence"]) / F.size(a),
            ).alias("confidence"),
            F.when(
                d["level"] == "full",
                F.format_string("ensemble_%d_models_full_agreement", d["total"]),
            )
            .when(
                d["level"] == "majority",
                F.format_string("ensemble_%d_of_%d_agree", d["agree"], d["total"]),
            )
            .otherwise("ensemble_confidence_weighted")
            .alias("source"),
        )

    return let(let(_votes(used), decide), finish)


def timeline_vote(df: DataFrame, models: Sequence[str] = TIMELINE_MODELS) -> DataFrame:
    """Vote for the timeline: recognised labels first, ties to the earlier model.

    Reads ``<model>_label`` and ``<model>_confidence``; a null label is an
    absent model. Adds emotion, agreement_level, models_agree, total_models,
    confidence and source; and arousal and valence, where ``<model>_arousal`` and
    ``<model>_valence`` are there for any model.
    """
    items = []
    for m in models:
        label = F.col(f"{m}_label")
        normal = timeline_label(label)
        items.append(
            F.when(
                label.isNotNull(),
                _prediction(normal["label"], normal["is_known"], F.col(f"{m}_confidence")),
            )
        )

    def usable(every: Column) -> Column:
        known = F.filter(every, lambda p: p["known"])
        return let(known, lambda k: F.when(F.size(k) > 0, k).otherwise(every))

    vote = let(let(_present(items), usable), _settle)
    fields = ("emotion", "agreement_level", "models_agree", "total_models", "confidence", "source")
    affect = []
    for dimension in ("arousal", "valence"):
        if any(f"{m}_{dimension}" in df.columns for m in models):
            value = {m: F.col(f"{m}_{dimension}") if f"{m}_{dimension}" in df.columns else F.lit(None) for m in models}
            pairs = [(F.col(f"{m}_label").isNotNull(), value[m]) for m in models]
            affect.append(ensemble_affect(pairs).alias(dimension))
    return (
        df.where(F.coalesce(*[F.col(f"{m}_label") for m in models]).isNotNull())
        .withColumn("__vote", vote)
        .select(*df.columns, *[F.col(f"__vote.{f}").alias(f) for f in fields], *affect)
    )


def reference_models(df: DataFrame, keys: Sequence[str], models: Sequence[str] = TIMELINE_MODELS) -> DataFrame:
    """The first model of ``models`` that has any label, per recording."""
    seen = df.groupBy(*keys).agg(*[F.count(f"{m}_label").alias(m) for m in models])
    return seen.select(*keys, F.coalesce(*[F.when(F.col(m) > 0, m) for m in models]).alias("reference"))


def align_to_reference(df: DataFrame, keys: Sequence[str], models: Sequence[str] = TIMELINE_MODELS) -> DataFrame:
    """Rows that the recording's reference model labels, with the other models where they agree on the row."""
    label = F.coalesce(*[F.when(F.col("reference") == m, F.col(f"{m}_label")) for m in models])
    return df.join(reference_models(df, keys, models), list(keys)).where(label.isNotNull())


def ensemble_affect(models: Sequence[tuple[Column, Column]], default: float = 0.5) -> Column:
    """Mean of a dimension over the present models, given as (is present, value).

    ``default`` stands for a present model without a value; absent models don't
    count. Null without any model.
    """
    total = sum((F.when(here, F.coalesce(v, F.lit(default))).otherwise(0.0) for here, v in models), F.lit(0.0))
    return F.try_divide(total, sum((here.cast("int") for here, _ in models), F.lit(0)))


def export_vote(
    df: DataFrame,
    models: Sequence[str] = EXPORT_MODELS,
    canonical: bool = True,
    final: str = "emotion_final",
    agreement: str = "emotion_agreement",
) -> DataFrame:
    """Vote for the export table: unanimous, two or more, else most confident."""
    items = []
    for m in models:
        raw = F.col(f"{m}_label")
        label = vote_label(raw) if canonical else F.lower(F.trim(raw))
        items.append(
            F.when(
                raw.isNotNull() & (raw != ""),
                _prediction(label, F.lit(True), F.col(f"{m}_confidence")),
            )
        )
    def settle(used: Column) -> Column:
        def decide(votes: Column) -> Column:
            n, top = F.size(used), F.array_max(votes)
            return F.struct(
                F.when(n == 0, "unknown")
                .when((n > 1) & (top == 1), _most_confident(used))
                .otherwise(_first_with(used, votes, top))
                .alias("emotion"),
                F.when(n == 0, "no_data")
                .when(n == 1, "single")
                .when(top == n, "full")
                .when(top >= 2, "majority")
                .otherwise("confidence")
                .alias("level"),
            )

        return let(_votes(used), decide)

    return df.withColumn("__vote", let(_present(items), settle)).select(
        *df.columns,
        F.col("__vote.emotion").alias(final),
        F.col("__vote.level").alias(agreement),
    )


def plain_majority(labels: Sequence[Column]) -> Column:
    """Most frequent label of a row; ties go to the smallest label."""
    every = F.filter(F.array(*labels), lambda x: x.isNotNull())

    def pick(a: Column) -> Column:
        scored = F.transform(
            F.array_distinct(a),
            lambda x: F.struct((-F.size(F.filter(a, lambda y: y == x))).alias("n"), x.alias("x")),
        )
        return F.array_min(scored)["x"]

    return let(every, pick)


def agreement_partition(df: DataFrame) -> DataFrame:
    """How many rows agree fully, two to one or not at all, canonical and raw."""
    both = export_vote(df, canonical=True, final="__f1", agreement="canonical")
    both = export_vote(both, canonical=False, final="__f2", agreement="raw")
    return both.select(
        F.explode(
            F.array(
                F.struct(F.lit("canonical").alias("labels"), F.col("canonical").alias("level")),
                F.struct(F.lit("raw").alias("labels"), F.col("raw").alias("level")),
            )
        ).alias("x")
    ).groupBy("x.labels", "x.level").agg(F.count(F.lit(1)).alias("n"))


def emotion_changes(
    df: DataFrame, keys: Sequence[str], order: str, emotion: str, chunk: Column
) -> DataFrame:
    """Changes between neighbouring rows and their rate in percent."""
    seen = ordered_scan(df, keys, [order], chunk, lags={"__prev": F.col(emotion)})
    return seen.groupBy(*keys).agg(
        F.count_if(F.col("__prev") != F.col(emotion)).alias("emotion_changes"),
        F.coalesce(
            F.try_divide(
                F.count_if(F.col("__prev") != F.col(emotion)) * 100.0, F.count(F.lit(1)) - 1
            ),
            F.lit(0.0),
        ).alias("change_rate"),
    )


def quality_report(df: DataFrame, keys: Sequence[str], order: str, chunk: Column) -> DataFrame:
    """Agreement, confidence, neutral share, change rate, score and warnings."""
    seen = ordered_scan(df, keys, [order], chunk, lags={"__prev": F.col("emotion")})
    level = F.col("agreement_level")
    base = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(level == "full").alias("full"),
        F.count_if(level == "majority").alias("majority"),
        F.count_if(level == "disagreement").alias("disagreement"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(F.col("confidence") < 0.3).alias("low_confidence_count"),
        F.count_if(F.col("emotion") == "neutral").alias("neutral"),
        F.count_if(F.col("__prev") != F.col("emotion")).alias("emotion_changes"),
    )
    n = F.col("total_segments")
    base = (
        base.withColumn("agreement_rate", (F.col("full") + F.col("majority")) * 100.0 / n)
        .withColumn("neutral_pct", F.col("neutral") * 100.0 / n)
        .withColumn(
            "change_rate",
            F.coalesce(F.try_divide(F.col("emotion_changes") * 100.0, n - 1), F.lit(0.0)),
        )
    )
    rate, conf = F.col("agreement_rate"), F.col("avg_confidence")
    neutral, change = F.col("neutral_pct"), F.col("change_rate")
    warnings = F.filter(
        F.array(
            F.when(rate < 50, "low_agreement"),
            F.when(conf < 0.4, "low_confidence"),
            F.when((neutral < 65) | (neutral > 90), "unusual_neutral_share"),
            F.when(change > 60, "high_change_rate"),
            F.when(F.col("low_confidence_count") > n * 0.3, "many_low_confidence"),
        ),
        lambda w: w.isNotNull(),
    )
    return base.withColumn(
        "quality_score",
        rate * 0.4
        + conf * 100 * 0.3
        + (100 - F.abs(neutral - 80)) * 0.2
        + (100 - change) * 0.1,
    ).withColumn("warnings", warnings)
