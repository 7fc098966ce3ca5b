"""Eligibility, adaptive thresholds and the gate in front of the classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .scan import exact_quantiles, quantiles_of_ranks, value_ranks


def _not_blank(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n")) != ""


def eligible(
    has_speech: Column,
    text: Column,
    is_advertisement: Column | None = None,
    skip_ads: bool = True,
    speech_default: bool = False,
) -> Column:
    """Worth scoring: speech, not a skipped advertisement, some text."""
    ok = F.coalesce(has_speech, F.lit(speech_default)) & _not_blank(text)
    if is_advertisement is not None and skip_ads:
        ok = ok & ~F.coalesce(is_advertisement, F.lit(False))
    return ok


def skip_reason(
    has_speech: Column,
    text: Column,
    is_advertisement: Column | None = None,
    speech_default: bool = False,
    no_text: str = "no_text",
) -> Column:
    """The reasons that apply, joined; ``unknown`` when none does."""
    ads = F.lit(False) if is_advertisement is None else F.coalesce(is_advertisement, F.lit(False))
    reasons = F.concat_ws(
        "_",
        F.when(~F.coalesce(has_speech, F.lit(speech_default)), "no_speech"),
        F.when(ads, "advertisement"),
        F.when(~_not_blank(text), no_text),
    )
    return F.when(reasons == "", "unknown").otherwise(reasons)


def translatable(df: DataFrame, text: str, speech: str = "has_speech") -> DataFrame:
    """Rows with speech and a text to translate."""
    return df.where((F.coalesce(F.col(text), F.lit("")) != "") & F.col(speech))


def with_translation(df: DataFrame, done: DataFrame, keys: Sequence[str], out: str = "text_en") -> DataFrame:
    """All rows with their translation from ``done``, empty where there is none."""
    return df.join(done.select(*keys, out), list(keys), "left").withColumn(out, F.coalesce(out, F.lit("")))


def thresholds(
    df: DataFrame, keys: Sequence[str], value: str, method: str = "median"
) -> DataFrame:
    """One arousal threshold per group; groups without a score get 0.5.

    median (also for unknown names), mean, percentile_60, or mad: the median
    plus the median distance from it.
    """
    groups = df.select(*keys).distinct()
    if method == "mean":
        found = df.groupBy(*keys).agg(F.avg(value).alias("threshold"))
    else:
        p = 0.6 if method == "percentile_60" else 0.5
        found = exact_quantiles(df, keys, value, {"threshold": p})
    if method == "mad":
        away = df.join(found, list(keys)).select(
            *keys, F.abs(F.col(value) - F.col("threshold")).alias("__away")
        )
        spread = exact_quantiles(away, keys, "__away", {"__mad": 0.5})
        found = found.join(spread, list(keys)).select(
            *keys, (F.col("threshold") + F.col("__mad")).alias("threshold")
        )
    return groups.join(found, list(keys), "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(0.5))
    )


def flag_significant(
    df: DataFrame, keys: Sequence[str], value: str, method: str = "median"
) -> DataFrame:
    """Mark rows above their group's threshold, with their percent rank.

    The rank comes from counts per distinct value, so a group of any size is
    spread over tasks; rows join it by value.
    """
    ranks = materialize(value_ranks(df, keys, value), "score-ranks")
    if method in ("mean", "mad"):
        limits = thresholds(df, keys, value, method)
    else:
        p = 0.6 if method == "percentile_60" else 0.5
        limits = quantiles_of_ranks(ranks, keys, value, {"threshold": p})
    totals = ranks.groupBy(*keys).agg(F.sum("n_equal").alias("__n"))
    per_value = ranks.join(limits.join(totals, list(keys)), list(keys)).select(
        *keys,
        value,
        (F.col(value) > F.col("threshold")).alias("is_emotionally_significant"),
        F.col("threshold").alias("threshold_used"),
        F.bround(F.col("n_below") * 100.0 / F.col("__n"), 1).alias("arousal_percentile"),
    )
    # Rows without a score stay out of the join: they would share one null key.
    scored = df.where(F.col(value).isNotNull()).join(per_value, [*keys, value])
    unscored = df.where(F.col(value).isNull()).select(
        "*",
        F.lit(False).alias("is_emotionally_significant"),
        F.lit(None).cast("double").alias("threshold_used"),
        F.lit(None).cast("double").alias("arousal_percentile"),
    )
    return scored.select(unscored.columns).unionByName(unscored)


def score_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[int] = (10, 25, 50, 75, 90),
) -> DataFrame:
    """Mean, population deviation, extremes and percentiles, 0 when empty."""
    plain = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    wanted = {f"p{p}": p / 100 for p in probabilities}
    q = exact_quantiles(df, keys, value, wanted)
    out = plain.join(q, list(keys), "left")
    columns = [c for c in out.columns if c not in keys]
    return out.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def correlation(x: Column, y: Column) -> Column:
    """Pearson aggregate; null for a constant side, which ``corr`` refuses."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 1e-16, spread))


def segment_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals, speech, text, advertisements, scored, skipped, significant."""
    scored = F.col("arousal").isNotNull()
    significant = F.count_if(F.col("is_emotionally_significant"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if("has_speech").alias("segments_with_speech"),
        F.count_if(_not_blank(F.col("text"))).alias("segments_with_text"),
        F.count_if("is_advertisement").alias("advertisement_segments"),
        F.count_if(scored).alias("classified_segments"),
        F.count_if(~scored).alias("skipped_segments"),
        significant.alias("significant_count"),
        F.coalesce(F.try_divide(significant * 100.0, F.count_if(scored)), F.lit(0.0)).alias(
            "significant_percentage"
        ),
    )


def gate(
    segments: DataFrame, scores: DataFrame, keys: Sequence[str], text: str = "text"
) -> DataFrame:
    """Segments with their arousal and whether the classifier should see them.

    ``to_classify`` is decided before any model runs, so filter on it first.
    """
    joined = segments.join(
        scores.select(*keys, "arousal", "valence", "is_emotionally_significant"),
        list(keys),
        "left",
    )
    significant = F.coalesce("is_emotionally_significant", F.lit(False))
    return joined.withColumn("is_emotionally_significant", significant).withColumn(
        "to_classify", significant & F.coalesce("has_speech", F.lit(True)) & _not_blank(F.col(text))
    )


def merge_gated(
    gated: DataFrame, predictions: DataFrame, keys: Sequence[str], group: Sequence[str]
) -> DataFrame:
    """Join predictions back; everything not classified becomes neutral.

    Where no row of a group qualified, the significance flag is reset.
    """
    any_left = gated.groupBy(*group).agg(F.max("to_classify").alias("__any"))
    out = gated.join(
        predictions.select(*keys, "label", "confidence", "probabilities"), list(keys), "left"
    ).join(any_left, list(group), "left")
    hit = F.col("to_classify") & F.col("label").isNotNull()
    return out.select(
        *[c for c in gated.columns if c not in ("to_classify", "is_emotionally_significant")],
        (F.col("is_emotionally_significant") & F.col("__any")).alias("is_emotionally_significant"),
        F.when(hit, F.col("label")).otherwise("neutral").alias("predicted_emotion"),
        F.when(hit, F.col("confidence")).otherwise(1.0).alias("confidence"),
        F.when(hit, F.col("probabilities")).alias("probabilities"),
        F.when(hit, "model").otherwise("intensity_filter").alias("classification_method"),
    )


def emotion_distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and percentage per label; filtered rows count as neutral."""
    counts = df.groupBy(*keys, "predicted_emotion").agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(F.when(F.col("classification_method") == "model", F.col("confidence"))).alias(
            "average_confidence_classified"
        ),
    )
    return counts.join(totals, list(keys)).select(
        *keys,
        "predicted_emotion",
        "n",
        F.bround(F.col("n") * 100.0 / F.col("total"), 1).alias("percentage"),
        F.coalesce("average_confidence_classified", F.lit(0.0)).alias(
            "average_confidence_classified"
        ),
    )


def intensity_level(value: Column) -> Column:
    """1 to 5, cut at .2 .4 .6 .8."""
    return (
        F.when(value < 0.2, 1)
        .when(value < 0.4, 2)
        .when(value < 0.6, 3)
        .when(value < 0.8, 4)
        .when(value.isNotNull(), 5)
    )


def range_inside_label(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Range of a score inside each label against the whole group's range."""
    inside = df.groupBy(*keys, label).agg(
        (F.max(value) - F.min(value)).alias("label_range"), F.count(F.lit(1)).alias("n")
    )
    whole = df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("group_range"))
    return inside.join(whole, list(keys)).withColumn(
        "share_of_range", F.try_divide("label_range", "group_range")
    )
