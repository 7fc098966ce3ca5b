"""Corpus pipeline: each stage applies one operator to all its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps, with the columns of ``documents`` (the last adds
the copy's number and the mixing order). ``run`` writes each result as Parquet to
the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import affect_engine
from affect_engine.llm import decontam, line_dedup, mixing, ngram_join, queries
from affect_engine.llm.tables import saved

cloudpickle.register_pickle_by_value(affect_engine)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    scored = queries.toxic_scores(docs, queries.table(spark, sf_dir, "labels"))
    return scored.filter(scored[scored.columns[-1]] < 0.3).select(docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share."""
    return line_dedup.drop_boilerplate(docs).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    linked = ngram_join.link(docs, size=5, percent=80)
    others = linked.filter("component_id <> doc_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontam.leaks(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to equal shares, in mixed order."""
    return mixing.mix(docs, queries.even_rates(docs), seed=queries.MIX_SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("n-gram join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The toxicity stage trains a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
