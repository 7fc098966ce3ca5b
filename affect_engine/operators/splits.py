"""Seeded, leakage-free splits.

Order comes from ``md5(key || seed)``, so a split does not depend on
partitioning, can be repeated elsewhere, and its first hex digits cut any class
into even chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import hash_chunk
from .scan import ordered_scan


def _hashed(df: DataFrame, key: str, seed: str) -> DataFrame:
    return df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))))


def _ranked(df: DataFrame, keys: list[str], key: str, seed: str, digits: int = 3) -> DataFrame:
    return ordered_scan(
        _hashed(df, key, seed), keys, ["__h", key], hash_chunk(F.col("__h"), digits), position="__rank"
    ).drop("__h")


def grouped_stratified_split(
    df: DataFrame, row: str, text: str, label: str, fraction: float, seed: str = "42", digits: int = 3
) -> DataFrame:
    """Adds ``side``; all copies of a text share one, per class of its first row."""
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"fraction must be in (0, 1), got {fraction}")
    # The digest that orders the texts also names them: no text is a key.
    rows = _hashed(df, text, seed)
    texts = rows.groupBy("__h").agg(F.min_by(label, row).alias("__class"))
    sizes = texts.groupBy("__class").agg(F.count(F.lit(1)).alias("__g"))
    ranked = ordered_scan(texts, ["__class"], ["__h"], hash_chunk(F.col("__h"), digits), position="__rank")
    g = F.col("__g")
    n_val = F.least(g - 1, F.greatest(F.lit(1), F.bround(g * F.lit(fraction), 0)))
    side = F.when(F.col("__rank") <= n_val, "validation").otherwise("train")
    sided = ranked.join(sizes, "__class").select("__h", side.alias("side"))
    return rows.join(sided, "__h").drop("__h")


def stratified_split(
    df: DataFrame, row: str, label: str, validation: float, test: float, seed: str = "42"
) -> DataFrame:
    """Adds ``side`` train, validation or test, by class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__g"))
    ranked = _ranked(df, [label], row, seed).join(sizes, label)
    n_test = F.bround(F.col("__g") * F.lit(test), 0)
    n_val = F.bround(F.col("__g") * F.lit(validation), 0)
    rank = F.col("__rank")
    side = F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "validation").otherwise("train")
    return ranked.withColumn("side", side).select(*df.columns, "side")


def stratified_folds(df: DataFrame, row: str, label: str, k: int, seed: str = "42") -> DataFrame:
    ranked = _ranked(df, [label], row, seed)
    return ranked.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k))).drop("__rank")


def shuffled_split(
    df: DataFrame, row: str, train: float = 0.8, validation: float = 0.15, seed: str = "42", digits: int = 3
) -> DataFrame:
    """Exact shares of a seeded global order."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    # One row.
    ranked = _ranked(df, [], row, seed, digits).join(F.broadcast(total), how="cross")
    n_train = F.floor(F.col("__n") * F.lit(train))
    n_val = F.floor(F.col("__n") * F.lit(validation))
    rank = F.col("__rank")
    side = F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "valid").otherwise("test")
    return ranked.withColumn("side", side).select(*df.columns, "side")


def holdout(df: DataFrame, row: str, fraction: float, at_least: int = 20, seed: str = "42", digits: int = 3) -> DataFrame:
    """Random holdout of a share of the rows, never fewer than ``at_least``."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    ranked = _ranked(df, [], row, seed, digits).join(F.broadcast(total), how="cross")
    n = F.greatest(F.lit(at_least), F.floor(F.col("__n") * F.lit(fraction)))
    return ranked.withColumn("held_out", F.col("__rank") <= n).select(*df.columns, "held_out")


def subsample(df: DataFrame, row: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows without replacement, the same ones every time."""
    return _hashed(df, row, seed).orderBy("__h", row).limit(n).drop("__h")


def leakage(df: DataFrame, text: str, side: str, row: str) -> DataFrame:
    """Texts on more than one side, and whether every row is used once."""
    cells = df.groupBy(F.md5(F.col(text).cast("string")).alias("__t"), side).agg(F.count(F.lit(1)).alias("n"))
    shared = cells.groupBy("__t").agg(F.count(F.lit(1)).alias("sides")).agg(
        F.count_if(F.col("sides") > 1).alias("leaking_texts")
    )
    rows = df.groupBy(row).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_rows")
    )
    return shared.join(F.broadcast(rows), how="cross")


def shared_passages(left: DataFrame, right: DataFrame, n: int, left_key: str, right_key: str) -> DataFrame:
    """Pairs of texts sharing a run of ``n`` words.

    Runs join by two hashes, 96 bits together; no run is shuffled as text. The
    left side is the smaller one: it is reduced to distinct runs first, and the
    right one only after the join.
    """
    from ..functions.text import words

    def grams(df: DataFrame, key: str) -> DataFrame:
        tokens = df.select(key, words(F.lower("text")).alias("w")).where(F.size("w") >= n)
        starts = F.sequence(F.lit(1), F.size("w") - (n - 1))

        def run(i: Column) -> Column:
            part = F.slice("w", i, n)
            return F.struct(F.xxhash64(part).alias("h1"), F.hash(part).alias("h2"))

        return tokens.select(key, F.inline(F.transform(starts, run)))

    found = grams(left, left_key).distinct().join(grams(right, right_key), ["h1", "h2"])
    return found.select(left_key, right_key).distinct()
