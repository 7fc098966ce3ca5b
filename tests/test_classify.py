"""Fitted features and classifiers: saved, applied to other rows, judged on them."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from affect_engine.operators import classify, evaluation

TOPICS = {"joy": "sun smile party happy", "fear": "dark alone scream night", "anger": "shout fight hate red"}


@pytest.fixture(scope="module")
def folds(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        label = rng.choice(sorted(TOPICS))
        words = [rng.choice(TOPICS[label].split()) if rng.random() < 0.5 else f"word{rng.randrange(60)}" for _ in range(12)]
        rows.append((i, " ".join(words) + rng.choice(["", "!", "?!"]), label, rng.random()))
    df = spark.createDataFrame(rows, "id long, text string, label string, confidence double")
    return rows, df.where("id % 3 > 0"), df.where("id % 3 = 0")


def test_vectors_equal_a_plain_version(spark, folds, tmp_path):
    rows, train, _ = folds
    lexicon = spark.createDataFrame([("sun", 1.0), ("dark", -1.0)], "word string, polarity double")
    column = classify.TextColumn("text", max_features=30, stop_words=("alone",))
    fitted = classify.fit_features(train, "id", [column], numbers=["confidence"], counted=["text"], polarity="text", lexicon=lexicon)
    fitted.save(str(tmp_path / "f"))
    loaded = classify.Features.load(spark, str(tmp_path / "f"))
    assert loaded == fitted and loaded.size == 30 + 1 + 5 + 1
    other = spark.createDataFrame([(1000, "The SUN the sun x dark night night !", None), (1001, None, 0.5), (1002, "unseen", 0.1)], "id long, text string, confidence double")
    got = {r.id: dict(zip(r.indices, r["values"], strict=True)) for r in loaded.apply(other, "id").collect()}

    def terms(text):
        w = [x for x in re.findall(r"\b\w\w+\b", (text or "").lower()) if x != "alone"]
        return w + [" ".join(p) for p in zip(w, w[1:], strict=False)]

    own = [r for r in rows if r[0] % 3]
    df, tf = {}, {}
    for _, text, *_ in own:
        for x in terms(text):
            tf[x] = tf.get(x, 0) + 1
        for x in set(terms(text)):
            df[x] = df.get(x, 0) + 1
    kept = sorted(sorted((x for x in df if df[x] >= 2), key=lambda x: (-tf[x], x))[:30])
    idf = {x: math.log((1 + len(own)) / (1 + df[x])) + 1 for x in kept}
    raw = {kept.index(x): terms("The SUN the sun x dark night night !").count(x) * idf[x] for x in kept if x in terms("The SUN the sun x dark night night !")}
    length = math.sqrt(sum(v * v for v in raw.values()))
    want = {i: v / length for i, v in raw.items()}
    assert {i: v for i, v in got[1000].items() if i < 30} == pytest.approx(want)
    # A missing number counts as the mean, so as 0; then counters of the text; sun twice, dark once.
    assert 30 not in got[1000] and got[1000][31] == 36 and got[1000][33] == 1 and got[1000][36] == pytest.approx(1 / 3)
    mean = sum(r[3] for r in own) / len(own)
    deviation = math.sqrt(sum((r[3] - mean) ** 2 for r in own) / len(own))
    assert got[1001] == pytest.approx({30: (0.5 - mean) / deviation})


@pytest.mark.parametrize(("kind", "options"), [("logistic", {"iterations": 30}), ("forest", {"trees": 12, "depth": 8}), ("bayes", {})])
def test_held_out_accuracy(spark, folds, kind, options):
    _, train, held = folds
    column = classify.TextColumn("text", sizes=(1,), weight="count" if kind == "bayes" else "tf-idf", max_features=200)
    fitted = classify.fit_features(train, "id", [column])
    vectors = lambda rows: classify.as_vectors(fitted.apply(rows, "id").join(rows.select("id", "label"), "id"))
    out = classify.train(vectors(train), "label", kind, **options)(vectors(held))
    summary = evaluation.summary_metrics(evaluation.confusion_cells(out, "label", "predicted")).first()
    assert summary.accuracy >= 0.9 and out.count() == held.count()


def test_wrong_options(spark, folds):
    _, train, _ = folds
    rows = train.withColumn("x", F.lit(1))
    with pytest.raises(ValueError, match="unknown classifier"):
        classify.train(rows, "label", "tree")


@pytest.mark.parametrize("weight", ["tf-idf", "log tf-idf", "count", "binary"])
def test_rows_with_a_key_each_take_no_shuffle_of_cells(spark, folds, weight):
    _, train, held = folds
    lexicon = spark.createDataFrame([("sun", 1.0), ("dark", -1.0)], "word string, polarity double")
    columns = [classify.TextColumn("text", sizes=(1, 2, 3), max_features=90, weight=weight), classify.TextColumn("label", sizes=(1,), max_features=5)]
    fitted = classify.fit_features(train, "id", columns, numbers=["confidence"], counted=["text"], polarity="text", lexicon=lexicon)
    empty = spark.createDataFrame([(900, None, None, None), (901, "", "", 0.5)], held.schema)
    rows = held.unionByName(empty)
    want = {}
    for r in fitted.cells(rows, "id").collect():
        want.setdefault(r.id, {})[r.position] = r.value
    out = fitted.apply(rows, "id")
    assert "WindowExec" not in out._jdf.queryExecution().executedPlan().toString() and "collect_list" not in out._jdf.queryExecution().toString()
    found = out.collect()
    assert len(found) == rows.count()
    for r in found:
        assert r.indices == sorted(r.indices) and dict(zip(r.indices, r["values"], strict=True)) == pytest.approx(want.get(r.id, {}))
    twice = fitted.apply(rows.unionByName(rows), "id")
    assert "collect_list" in twice._jdf.queryExecution().toString()
