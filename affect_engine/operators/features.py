"""Text and vector features, neighbours and classifiers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sentences import norm
from ..functions.text import text_counters, words
from ..session import materialize
from . import neighbours
from .scan import chunk_of, ordered_scan

RESERVED_TOKENS = 8


#: Tokens of the rows that are counted together.
COUNTED_TOKENS = 1_000_000


def _runs(tokens: pa.Array, row: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """Runs of ``n`` tokens of one row, joined by a blank, with their rows."""
    if n == 1:
        return tokens, row
    starts = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
    return pc.binary_join_element_wise(*(tokens.take(pa.array(starts + i)) for i in range(n)), " "), row[starts]


def _counted(batches: Iterator[pa.RecordBatch], key: str, sizes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A null list has no tokens.
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + COUNTED_TOKENS, side="right")))
            lists = batch.column(1).slice(at, to - at)
            tokens, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            runs = [_runs(tokens, row, n) for n in sizes]
            terms = pa.chunked_array([r[0] for r in runs], tokens.type)
            found = pa.table({"row": np.concatenate([r[1] for r in runs]), "term": terms}).group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()
            rows = pa.table({key: batch.column(0).slice(at, to - at).take(found["row"]), "term": found["term"], "tf": found["count_all"].cast(pa.int64())})
            yield from rows.to_batches()
            at = to


def term_counts(df: DataFrame, key: str, tokens: Column, sizes: Sequence[int] = (1,)) -> DataFrame:
    """Rows (key, term, tf) of the runs of the given lengths, as space-joined strings.

    A row's terms are counted where it lies. They are added up by key only if a
    key has several rows, so no hash table holds the terms of many texts.
    """
    rows = df.select(F.col(key), tokens.alias("__t"))
    schema = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    counts = rows.mapInArrow(lambda it: _counted(it, key, list(sizes)), schema)
    if df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return counts
    return counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def tf_idf(
    counts: DataFrame,
    key: str,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
    sublinear: bool = False,
    binary: bool = False,
    corpus: DataFrame | None = None,
) -> DataFrame:
    """L2-normalised weights with idf = ln((1 + n) / (1 + df)) + 1.

    ``n`` counts the rows of ``corpus``, the documents with and without terms;
    without it, those that have a term.

    A term's document count may be a third of all rows, but per term it is one
    number; it joins back by term, where adaptive skew handling splits a
    frequent term's rows.
    """
    # Counts that are cut to few terms are made again: written, they take three times the texts.
    if max_features is None:
        counts = materialize(counts, "term-counts")
    documents = counts.agg(F.count_distinct(key).alias("__n"))
    if corpus is not None:
        documents = corpus.agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("__all"))
    # One row.
    kept = totals.join(F.broadcast(documents), how="cross").where(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("__n") * F.lit(float(max_df)))
    )
    if max_features is not None:
        kept = kept.orderBy(F.desc("__all"), "term").limit(max_features)
        # Written, so that Spark knows how few they are.
        kept = materialize(kept, "kept-terms")
    idf = F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1
    tf = F.col("tf").cast("double")
    if binary:
        weight = F.lit(1.0)
    else:
        weight = (1 + F.log(tf) if sublinear else tf) * F.col("__idf")
    weighted = counts.join(kept.select("term", idf.alias("__idf")), "term").select(
        key, "term", weight.alias("__w")
    )
    if binary:
        return weighted.withColumnRenamed("__w", "weight")
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("__w") / length).alias("weight"))


def term_maps(weights: DataFrame, key: str, least: float = 0.001) -> DataFrame:
    """Term-to-weight map per document; a document's terms are bounded by its text."""
    return weights.where(F.col("weight") >= least).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights")
    )


def group_rows(df: DataFrame, keys: Sequence[str], order: str, chunk: Column, size: int = 5) -> DataFrame:
    """Number rows ``size`` at a time in ``doc``."""
    numbered = ordered_scan(df, keys, [order], chunk, position="__pos")
    return numbered.withColumn("doc", F.floor((F.col("__pos") - 1) / size).cast("long")).drop("__pos")


def vocabulary(df: DataFrame, tokens: Column, size: int) -> DataFrame:
    """Token ids by falling count after the reserved ids, ties by token."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    top = counts.orderBy(F.desc("n"), "token").limit(size - RESERVED_TOKENS)
    ranked = ordered_scan(
        top.withColumn("__neg", -F.col("n")),
        [],
        ["__neg", "token"],
        chunk_of(F.col("__neg"), 64),
        position="__pos",
    )
    return ranked.select("token", "n", (F.col("__pos") + RESERVED_TOKENS - 1).alias("id"))


def vocabulary_coverage(df: DataFrame, tokens: Column, table: DataFrame) -> DataFrame:
    """Share of distinct tokens and of all tokens the table knows."""
    counts = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )
    known = table.select("token").distinct().withColumn("__known", F.lit(True))
    seen = counts.join(known, "token", "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    hit = F.when(F.col("__known"), F.col("n")).otherwise(0)
    return seen.agg(
        (F.count_if("__known") / F.count(F.lit(1))).alias("distinct_share"),
        (F.sum(hit) / F.sum("n")).alias("token_share"),
    )


def entity_counts(df: DataFrame, entities: str) -> DataFrame:
    return df.select(F.explode(entities).alias("e")).groupBy("e.label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("e.text").alias("distinct_texts")
    )


def entities_text(entities: Column) -> Column:
    """Entities of one row joined as ``text(label)``."""
    return F.array_join(
        F.transform(entities, lambda e: F.concat(e["text"], F.lit("("), e["label"], F.lit(")"))), "; "
    )


def standardize(df: DataFrame, column: str, out: str) -> DataFrame:
    """Zero mean, unit population deviation."""
    stats = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    # One row.
    return df.join(F.broadcast(stats), how="cross").withColumn(
        out, (F.col(column) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    ).drop("__m", "__s")


def dense_features(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in text_counters(F.col(text)).items()])


def polarity(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity of the words of a text found in a lexicon table, else 0.

    Words are counted per text first; the lexicon joins by word. It is written
    first, so that Spark knows its size: one that fits is broadcast.
    """
    lexicon = materialize(lexicon, "lexicon")
    counts = term_counts(df, key, words(F.lower(text)))
    found = counts.join(lexicon.select(F.col("word").alias("term"), "polarity"), "term")
    scored = found.groupBy(key).agg(
        (F.sum(F.col("polarity") * F.col("tf")) / F.sum("tf")).alias("polarity")
    )
    return df.select(key).join(scored, key, "left").withColumn(
        "polarity", F.coalesce("polarity", F.lit(0.0))
    )


def embedding_statistics(df: DataFrame, vector: str) -> DataFrame:
    """Share of non-zero vectors, mean length, range of components."""
    size = norm(F.col(vector))
    return df.select(
        size.alias("l"), F.array_min(vector).alias("lo"), F.array_max(vector).alias("hi")
    ).agg(
        F.avg((F.col("l") > 1e-8).cast("double")).alias("non_zero_share"),
        F.avg("l").alias("mean_norm"),
        F.min("lo").cast("double").alias("min_value"),
        F.max("hi").cast("double").alias("max_value"),
    )


def probe_similarities(probes: DataFrame, table: DataFrame, key: str, vector: str, best: bool = False) -> DataFrame:
    """Cosine of every row of ``table`` with each probe, or with its ``best`` one, in blocks."""
    return neighbours.similarities(probes, table, key, vector, best)


def nearest(probes: DataFrame, table: DataFrame, key: str, vector: str, k: int, **options) -> DataFrame:
    """The k rows of ``table`` most similar to each probe, by the index of ``neighbours``."""
    return neighbours.nearest(probes, table, key, vector, k, **options).withColumnRenamed("score", "cosine")


def class_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, one row per (label, position)."""
    return (
        df.select(label, F.posexplode(vector).alias("position", "value"))
        .groupBy(label, "position")
        .agg(F.avg(F.col("value").cast("double")).alias("mean"))
    )
