"""Registered queries of the corpus-wide operators: passages, language model, benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lm, passages
from .registry import query, table


@query("op1_repeated_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated(table(spark, folder, "documents"))


@query("op3_lm_scores")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    scored = lm.score(table(spark, folder, "documents"), fold != 0)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op8_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
