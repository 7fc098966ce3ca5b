"""Token attributions: drop curves, top tokens, normalised scores, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]")


def area_between_curves(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum over steps of confidence when dropping least first minus most first."""
    least = F.sum(F.when(F.col("order") == "least_first", F.col("confidence")))
    most = F.sum(F.when(F.col("order") == "most_first", F.col("confidence")))
    area = F.coalesce(least, F.lit(0.0)) - F.coalesce(most, F.lit(0.0))
    return df.groupBy(*keys).agg(area.alias("area")).withColumn(
        "quality",
        F.when(F.col("area") > 1.0, "good").when(F.col("area") > 0.5, "moderate").otherwise("poor"),
    )


def top_tokens(scored: Column, k: int, by_magnitude: bool = True) -> Column:
    """The k strongest of an array of (token, position, score), specials removed."""
    kept = F.filter(scored, lambda x: ~x["token"].isin(list(SPECIAL_TOKENS)))
    strength = (lambda x: F.abs(x["score"])) if by_magnitude else (lambda x: x["score"])
    ordered = F.array_sort(
        F.transform(
            kept,
            lambda x: F.struct(
                (-strength(x)).alias("s"), x["position"].alias("p"), x["token"].alias("t")
            ),
        )
    )
    return F.slice(ordered, 1, k)


def normalized(scores: Column) -> Column:
    """Scores over their maximum, or unchanged when it is not positive."""
    top = F.array_max(scores)
    return F.transform(scores, lambda s: s / F.when(top > 0, top).otherwise(1.0))


def top_overlap(a: Column, b: Column) -> Column:
    """Shared and one-sided members of two top lists."""
    return F.struct(
        F.size(F.array_intersect(a, b)).alias("shared"),
        F.array_except(a, b).alias("only_a"),
        F.array_except(b, a).alias("only_b"),
    )
