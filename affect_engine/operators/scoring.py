"""Batch scoring with a model the caller brings.

The loader runs once per Python worker; only distinct, eligible texts reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALENCE_AROUSAL = T.StructType(
    [T.StructField("valence", T.DoubleType()), T.StructField("arousal", T.DoubleType())]
)
EMOTION = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
TRANSLATION = T.StringType()
VECTOR = T.ArrayType(T.FloatType())

Scorer = Callable[[list[str]], list]


def out_of_memory(error: Exception) -> bool:
    """Memory errors of Python, and of device libraries by their message."""
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def in_shrinking_batches(
    score: Scorer, texts: list[str], size: int, is_memory_error: Callable[[Exception], bool] = out_of_memory
) -> list:
    """Score in batches, halving the size on a memory error and failing at one."""
    out, at = [], 0
    while at < len(texts):
        try:
            out.extend(score(texts[at : at + size]))
            at += size
        except Exception as error:
            if size <= 1 or not is_memory_error(error):
                raise
            size = max(1, size // 2)
    return out


def batch_scorer(load: Callable[[], Scorer], kind: T.DataType, batch_size: int = 32):
    """A pandas UDF ``text -> kind`` around ``load() -> score(texts)``."""
    columns = kind.fieldNames() if isinstance(kind, T.StructType) else None

    @F.pandas_udf(kind)
    def score_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for texts in batches:
            values = in_shrinking_batches(score, texts.tolist(), batch_size)
            if columns:
                yield pd.DataFrame(
                    {c: [v[i] for v in values] for i, c in enumerate(columns)}, index=texts.index
                )
            else:
                yield pd.Series(values, index=texts.index, dtype=object)

    return score_column


def score_distinct(
    df: DataFrame,
    text: str,
    scorer,
    where: Column | None = None,
    out: str = "score",
    transform: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Score each distinct text once and join the result back.

    Models are pure in their text. A text shared by a third of all rows costs
    one call; its score joins back by the text's digest from a one-row side, and
    adaptive skew handling splits the rows that share it.
    """
    prepared = F.col(text) if transform is None else transform(F.col(text))
    wanted = F.lit(True) if where is None else where
    rows = df.withColumn("__text", F.when(wanted, prepared)).withColumn("__d", F.md5("__text"))
    asked = rows.where(F.col("__text").isNotNull())
    texts = asked.groupBy("__d").agg(F.any_value("__text").alias("__text"))
    scored = texts.withColumn(out, scorer(F.col("__text"))).drop("__text")
    # Skipped rows stay out of the join: they would share one null key.
    skipped = rows.where(F.col("__text").isNull()).withColumn(
        out, F.lit(None).cast(scored.schema[out].dataType)
    )
    return asked.join(scored, "__d").unionByName(skipped).drop("__text", "__d")


def lexicon_va(texts: Sequence[str]) -> list[tuple[float, float]]:
    """Deterministic stand-in for a model, for tests and the catalog."""
    return [
        ((len(x) * 7 % 1000) / 1000.0, (len(x) * 13 % 1000) / 1000.0) for x in texts
    ]
