"""Streaming forms of the stateless text operators and of keep-first.

These are additions: the same functions run on a stream because they are
Columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.intensity import eligible


def clean_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn(text, clean_text(F.col(text)))


def eligible_stream(rows: DataFrame) -> DataFrame:
    return rows.where(eligible(F.col("has_speech"), F.col("text")))


def first_copies(rows: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """One row per key within the watermark; state is dropped after ``delay``."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
