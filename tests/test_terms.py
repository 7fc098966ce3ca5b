"""Term counts and polarity: what they return, and what they don't shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from affect_engine.operators import features


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_a_row_lies(spark, monkeypatch):
    monkeypatch.setattr(features, "COUNTED_TOKENS", 4)
    rows = [(1, ["a", "b", "a", "b", "a"]), (2, ["b"]), (3, []), (4, None), (5, ["a", None, "b"]), (6, ["c", "c"])]
    df = spark.createDataFrame(rows, "id long, t array<string>").coalesce(1)
    counts = features.term_counts(df, "id", F.filter("t", lambda w: w.isNotNull()), (1, 2))
    want = Counter()
    for key, words in rows:
        words = [w for w in words or [] if w is not None]
        want.update((key, w) for w in words)
        want.update((key, f"{a} {b}") for a, b in zip(words, words[1:]))
    assert {(r.id, r.term): r.tf for r in counts.collect()} == want
    assert "Exchange" not in plan(counts)


def test_rows_of_one_key_are_added_up(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["a"]), (None, ["a"]), (None, ["a"])], "id long, t array<string>").repartition(3)
    found = {(r.id, r.term): r.tf for r in features.term_counts(df, "id", F.col("t"), (1, 2)).collect()}
    assert found == {(1, "a"): 2, (1, "b"): 1, (1, "a b"): 1, (2, "a"): 1, (None, "a"): 2}


def test_a_small_lexicon_is_broadcast(spark):
    df = spark.createDataFrame([(1, "Good good bad"), (2, ""), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("good", 4), ("bad", -2)], "word string, polarity int").groupBy("word").agg(F.max("polarity").alias("polarity"))
    found = features.polarity(df, "id", "text", lexicon)
    assert "BroadcastHashJoin [term" in plan(found)
    assert {r.id: r.polarity for r in found.collect()} == {1: 2.0, 2: 0.0, 3: 0.0}
