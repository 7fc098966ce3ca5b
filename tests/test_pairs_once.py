"""Pair building cleans and scores a pair once, and returns what plain filters return."""

from pyspark.sql import functions as F

from affect_engine.functions.pairs import clean_pair_text
from affect_engine.operators import corpus


def test_pairs_are_cleaned_and_scored_once(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, text, text.upper()), (2, text.title(), text), (3, " ", text), (4, None, text), (5, text + " 5", text), (6, "a " * 40, text), (7, text, "​")]
    pairs = spark.createDataFrame(rows, "id long, en string, ru string")
    built = corpus.build_pairs(pairs, "id", threshold=0.7)
    # One node a column.
    assert built._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    cleaned = pairs.select("id", clean_pair_text(F.col("en"), "en").alias("en"), clean_pair_text(F.col("ru"), "ru").alias("ru")).where("en <> '' AND ru <> ''")
    first = corpus.keep_first(cleaned, [F.lower("en"), F.lower("ru")], "id")
    fitting = first.where(corpus.pair_lengths_ok(F.col("en"), F.col("ru"), 66, 313))
    want = fitting.withColumn("score", corpus.pair_quality(F.col("en"), F.col("ru"))).where("score >= 0.7")
    got = sorted(map(tuple, built.collect()))
    assert got == sorted(map(tuple, want.collect())) and [r[0] for r in got] == [1, 5]
