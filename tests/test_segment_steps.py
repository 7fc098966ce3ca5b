"""Sentences meet their words, and sentences their neighbours, without a join."""

import random

from pyspark.sql import functions as F

from affect_engine.operators import segments

VOCAB = ["Sun", "moon", "rain.", "wind,", "Tree!", "…Up", "a.B", "snow...", "x;", "", "hill\tside", "end?No", "Лес.", "été"]


def rows(seed):
    rng = random.Random(seed)
    out = []
    for video in range(2):
        for scene in range(2):
            for i in range(90):
                at = 100.0 * scene + i
                out.append((video, scene, 7 * scene + i // 40, i % 40, rng.choice(VOCAB), at, at + 0.5, rng.random()))
    return out


def run(spark, data):
    words = spark.createDataFrame(data, "video_id long, global_scene_id long, segment_id long, i long, word string, start double, end double, probability double")
    numbered = segments.materialize(segments.number_words(words), "numbered")
    timed = segments.materialize(segments.timed_sentences(numbered, 9), "timed")
    packed = segments.pack_sentences(timed.withColumn("v", F.array(F.col("n_words").cast("double"), F.lit(1.0))), segments.Limits(3, 5, 12, 3), "v")
    return numbered, timed, packed


def told(df):
    return sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in r) for r in df.select(sorted(df.columns)).collect())


def test_small_chunks_change_nothing(spark, monkeypatch):
    data = rows(5)
    want = [told(x) for x in run(spark, data)]
    monkeypatch.setattr(segments, "WORD_CHUNK", 7)
    assert [told(x) for x in run(spark, data)] == want


def test_words_go_once(spark):
    numbered, timed, _ = run(spark, rows(6))
    own = {}
    for r in numbered.collect():
        own.setdefault((r.video_id, r.global_scene_id), {})[r.w] = r
    at = {}
    for r in sorted(timed.collect(), key=lambda r: (r.video_id, r.global_scene_id, r.s)):
        words, first = own[r.video_id, r.global_scene_id], at.get((r.video_id, r.global_scene_id), 0)
        taken = [words[w] for w in range(first, first + r.n_tokens) if w in words]
        at[r.video_id, r.global_scene_id] = first + r.n_tokens
        assert (r.start, r.end, r.n_words) == (taken[0].start, taken[-1].end, len(taken))
        assert abs(r.confidence_sum - sum(x.probability for x in taken)) < 1e-9
    plan = segments.timed_sentences(numbered, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.strip(" :+-").startswith("Join Inner, ") and "w#" in line for line in plan.splitlines())


def test_plain_words_are_their_own_token(spark):
    words = [*VOCAB, "A-b", "it's", "x.y", "no.", "a..", "1,5", "И.Я", "«a»", "a b", "ok!"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    both = df.select("word", segments._tokens(F.col("word")).alias("t"), F.col("word").rlike(segments._WHOLE).alias("whole")).collect()
    assert all(r.t == [r.word] for r in both if r.whole) and sum(r.whole for r in both) > 8
