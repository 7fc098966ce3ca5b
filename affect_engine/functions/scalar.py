"""Small scalar functions: ids, scales, probabilities, safe numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Where the 11-character id sits in a video address.
VIDEO_ID_PATTERNS = (
    r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/|youtube\.com/shorts/)([a-zA-Z0-9_-]{11})",
    r"youtube\.com/watch\?.*v=([a-zA-Z0-9_-]{11})",
)


def video_id(url: Column) -> Column:
    """Id in a video address, null when there is none."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_ID_PATTERNS]
    return F.coalesce(*found)


def safe_double(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def scale_to_unit(value: Column, low: float, high: float) -> Column:
    """Linear map of [low, high] to [0, 1], clipped; a bad range is an error."""
    if high <= low:
        raise ValueError(f"high ({high}) must be greater than low ({low})")
    return F.least(F.greatest((value - F.lit(float(low))) / float(high - low), F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array, shifted by the maximum."""

    def scaled(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda s, v: s + v)
        return let(total, lambda t: F.transform(powers, lambda v: v / t))

    shifted = let(
        logits, lambda a: let(F.array_max(a), lambda m: F.transform(a, lambda v: F.exp(v - m)))
    )
    return let(shifted, scaled)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return let(values, lambda a: F.array_position(a, F.array_max(a)) - 1)


def probability_map(labels: list[str], probabilities: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probabilities)
