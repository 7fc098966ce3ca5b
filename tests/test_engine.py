"""Votes, splits, scoring, streaming and sources on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from affect_engine.operators import corpus, ensemble, evaluation, export, scoring, splits
from affect_engine.session import checkpoint_root
from affect_engine.sources import readers, sinks
from affect_engine.streaming import progress, text_stream


def test_votes_differ_where_they_should(spark):
    rows = [
        ("joy", 0.5, "joy", 0.6, "Enthusiasm", 0.7),
        ("joy", 0.5, "fear", 0.9, None, None),
        ("joy", 0.5, "fear", 0.9, "anger", 0.9),
        ("love", 0.5, None, None, None, None),
        (None, None, "love", 0.9, "anger", 0.1),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "distil_label string, distil_confidence double, deberta_label string, deberta_confidence double, ru_label string, ru_confidence double")
    tl = {(r.emotion, r.agreement_level, r.total_models) for r in ensemble.timeline_vote(df).collect()}
    assert tl == {("joy", "full", 3), ("joy", "majority", 2), ("fear", "disagreement", 3), ("neutral", "majority", 1), ("anger", "majority", 1)}
    ex = [(r.emotion_final, r.emotion_agreement) for r in ensemble.export_vote(df).collect()]
    assert sorted(ex) == sorted([("joy", "full"), ("fear", "confidence"), ("anger", "confidence"), ("love", "single"), ("love", "confidence"), ("unknown", "no_data")])


def test_finished_run_reads_back(spark):
    rows = [("v", 0, "0.0", "5.0", "enthusiasm", "Happiness", "full"), ("v", 1, "5.0", "bad", "Neutral", "Neutral", ""), ("v", 2, "9.5", "14.0", "Anger", "Disgust", "majority")]
    df = spark.createDataFrame(rows, "video_id string, segment_id int, start_time string, end_time string, emotion_ru string, emotion_final string, emotion_agreement string")
    for c in export.EXPORT_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    back = export.read_back(df)
    assert [r.emotion_ru for r in back.orderBy("segment_id").collect()] == ["joy", "neutral", "anger"]
    s = export.run_summary(back).first()
    assert (s.segments, s.duration_seconds, s.agreement, s.emotions) == (3, 14.0, {"full": 1, "unknown": 1, "majority": 1}, {"joy": 1, "neutral": 1, "disgust": 1})


def test_grouped_split_properties(spark):
    rng = random.Random(1)
    rows = [(i, f"t{rng.randint(0, 150)}", "abc"[i % 3]) for i in range(300)] + [(999, "alone", "z")]
    df = spark.createDataFrame(rows, "row_id int, text string, label string")
    out = splits.grouped_stratified_split(df, "row_id", "text", "label", 0.2)
    assert out.count() == 301
    report = splits.leakage(out, "text", "side", "row_id").first()
    assert report.leaking_texts == 0 and report.repeated_rows == 0
    assert out.where("row_id = 999").first().side == "train"
    again = splits.grouped_stratified_split(df.repartition(3), "row_id", "text", "label", 0.2)
    assert set(out.collect()) == set(again.collect())
    with pytest.raises(ValueError):
        splits.grouped_stratified_split(df, "row_id", "text", "label", 1.0)


def test_balance_reaches_target_where_supply_allows(spark):
    rows = [(i, ["a"] if i % 2 else ["a", "b"] if i % 3 else ["c"]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, labels array<string>")
    have = {r.l: r.n for r in corpus.balance_multilabel(df, "id", "labels", 15).select(F.explode("labels").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()}
    assert all(have[x] >= 15 for x in "abc")


def test_weights_need_every_class(spark):
    df = spark.createDataFrame([("joy",), ("fear",)], "label string")
    with pytest.raises(Exception, match="absent class"):
        corpus.class_weights(df, "label").collect()


def test_flat_predictions_have_no_correlation(spark):
    df = spark.createDataFrame([(0.5, i / 10) for i in range(10)], "p double, t double")
    m = evaluation.regression_metrics(df, [], "p", "t").first()
    assert m.pearson is None and m.spearman is None and m.pred_std == 0


def test_batches_shrink_on_memory_errors():
    seen = []

    def score(texts):
        if len(texts) > 2:
            raise MemoryError
        seen.append(len(texts))
        return [t.upper() for t in texts]

    assert scoring.in_shrinking_batches(score, list("abcde"), 8) == list("ABCDE") and max(seen) == 2
    with pytest.raises(MemoryError):
        scoring.in_shrinking_batches(lambda t: (_ for _ in ()).throw(MemoryError()), ["a"], 4)


def log_lines(spark, rows):
    return spark.createDataFrame([(j, i, line) for i, (j, line) in enumerate(rows)], "job_id long, line_no long, line string")


def test_progress_and_reason(spark):
    lines = log_lines(spark, [
        (1, "STAGE 1: DOWNLOAD"), (1, "about STAGE 2 in prose"), (1, "STAGE 3: AUDIO"), (1, "STAGE 99: no"),
        (1, "2026-01-01 10:00:00 - ERROR - a.b - no file"), (1, "Failed: 1"), (1, "Pipeline stopped: Stage 3 failed"),
        (2, "STAGE 1: X"), (2, "STAGE 9: CSV"), (2, "PIPELINE COMPLETE (ALL STAGES)"),
    ])
    got = {r.job_id: r for r in progress.job_progress(lines).collect()}
    assert (got[1].stage, got[1].stages_done, got[1].failed_stage) == ("3", 1, "3")
    assert (got[2].stage, got[2].stages_done, got[2].complete) == ("9", 2, True)
    exits = spark.createDataFrame([(1, 1), (2, 0)], "job_id long, exit_code int")
    final = {r.job_id: r for r in progress.final_status(progress.job_progress(lines), exits).collect()}
    assert final[1].status == "failed" and final[1].error == "stage 3 failed"
    assert final[2].status == "succeeded" and final[2].stages_done == 12
    assert progress.failure_reason(lines).where("job_id = 1").first().reason == "no file"


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(1, 4), f"STAGE {rng.choice(['1', '2', '5A', '9'])}: X") for _ in range(60)]
    lines = log_lines(spark, rows)
    want = {r.job_id: (r.stage, r.stages_done) for r in progress.job_progress(lines).collect()}
    lines.orderBy(F.desc("line_no")).repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = str(tmp_path / "out")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    q = progress.stream_progress(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy("job_id").agg(F.max_by(F.struct("stage", "stages_done"), "batch").alias("r")).collect()
    assert {r.job_id: tuple(r.r) for r in last} == want


def test_text_functions_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "OMG!!!!", True), (2, " ", True)], "id int, text string, has_speech boolean").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id int, text string, has_speech boolean").parquet(str(tmp_path / "in"))
    q = text_stream.clean_stream(text_stream.eligible_stream(rows)).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select id, text from cleaned").collect()] == [(1, "oh my god")]


def test_lines_zip_to_the_shorter_file(spark, tmp_path):
    (tmp_path / "en").write_text("a\n\nb\nc\n")
    (tmp_path / "ru").write_text("x\ny\n")
    both = readers.zip_lines(readers.numbered_lines(spark, str(tmp_path / "en")), readers.numbered_lines(spark, str(tmp_path / "ru")))
    assert sorted((r.en, r.ru) for r in both.collect()) == [("a", "x"), ("b", "y")]


def test_table_checks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), (" ", 2), (None, 3)], "text string, n int").write.json(path)
    assert readers.table(spark, path, "jsonl", ["text"]).count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        readers.table(spark, path, "jsonl", ["label"])
    with pytest.raises(ValueError, match="usable rows"):
        readers.table(spark, path, "jsonl", ["text"], at_least=2)


def test_scratch_folder_is_stable_within_a_session(spark):
    assert checkpoint_root(spark) == checkpoint_root(spark)


class FakeState:
    """What ``_advance`` needs of a group's state."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, milliseconds):
        self.timeout = milliseconds


def test_idle_jobs_end_as_orphans_unless_they_had_ended():
    import pandas as pd

    def run(events):
        state = FakeState()
        batch = pd.DataFrame([(i, e, s) for i, (e, s) in enumerate(events)], columns=["line_no", "event", "stage"])
        list(progress._advance((7,), iter([batch]), state, 500))
        assert state.timeout == 500
        state.hasTimedOut = True
        out = list(progress._advance((7,), iter([]), state, 500))
        assert not state.exists
        return out

    (orphan,) = run([("stage", "1"), ("stage", "2")])
    assert orphan.loc[0, "orphaned"] and orphan.loc[0, "stages_done"] == 1 and orphan.loc[0, "stage"] == "2"
    assert run([("stage", "1"), ("complete", None)]) == []
    assert run([("stage", "1"), ("failed", "1")]) == []


def test_label_audits_count_any_label(spark):
    from affect_engine.operators import corpus, ensemble, evaluation

    rows = [("a", "love", "s"), ("a", "joy", "s"), ("b", "joy", "s"), ("c", None, "t"), ("c", "joy", "u")]
    df = spark.createDataFrame(rows, "text string, label string, source string")
    found = corpus.label_conflicts(df, "disgust").first()
    assert (found.repeated_texts, found.conflicting_texts, found.rows_involved, found.within_one_source) == (2, 1, 2, 1)
    assert {r.source: r.classes for r in corpus.source_signature(df).collect()} == {"s": 2, "t": 0, "u": 1}
    pairs = spark.createDataFrame([("joy", "love"), ("love", "joy"), (None, None)], "t string, p string")
    cells = {r.true: r for r in evaluation.confusion_matrix(pairs, "t", "p").collect()}
    assert (cells["joy"].other, cells["other"].joy, cells["other"].other) == (1, 1, 1)
    votes = spark.createDataFrame([(0.9, True), (0.9, True)], "x double, here boolean").limit(1)
    absent = [(F.lit(True), F.col("x")), (F.lit(True), F.col("x")), (F.lit(False), F.lit(None))]
    assert votes.select(ensemble.ensemble_affect(absent).alias("m")).first().m == 0.9


def test_recordings_follow_their_reference_model(spark):
    from affect_engine.operators import ensemble

    rows = [(1, 0, None, "joy", "fear"), (1, 1, None, None, "joy"), (2, 0, "joy", None, "fear"), (2, 1, None, "joy", None)]
    df = spark.createDataFrame(rows, "v long, s long, distil_label string, deberta_label string, ru_label string")
    found = {(r.v, r.s): r.reference for r in ensemble.align_to_reference(df, ["v"]).collect()}
    assert found == {(1, 0): "deberta", (2, 0): "distil"}


def test_memory_errors_by_message():
    def score(texts):
        if len(texts) > 2:
            raise RuntimeError("CUDA out of memory")
        return [t.upper() for t in texts]

    assert scoring.in_shrinking_batches(score, list("abcde"), 8) == list("ABCDE")
    with pytest.raises(RuntimeError, match="other"):
        scoring.in_shrinking_batches(lambda t: (_ for _ in ()).throw(RuntimeError("other")), ["a"], 4)


def test_balanced_rows_equal_a_greedy_pick(spark):
    rng = random.Random(11)
    names = "abcdef"
    rows = [(i, rng.sample(names, k=rng.choice([0, 1, 1, 2, 3]))) for i in range(400)] + [(500, None), (501, ["a", "a", "b"])]
    df = spark.createDataFrame(rows, "id long, labels array<string>")
    chosen = {r.id for r in corpus.balance_multilabel(df, "id", "labels", 40).collect()}
    have = {x: sum(x in set(labels or []) for i, labels in rows if i in chosen) for x in names}
    # The pick one row at a time, over the rows themselves.
    lacking, free, picked = dict.fromkeys(names, 40), {i: set(labels) for i, labels in rows if labels}, 0
    while free:
        score = {i: sum(max(lacking[x], 0) for x in own) for i, own in free.items()}
        best = max(score, key=score.get)
        if score[best] <= 0:
            break
        for x in free.pop(best):
            lacking[x] -= 1
        picked += 1
    for x in names:
        supply = sum(x in set(labels or []) for _, labels in rows)
        assert have[x] >= min(40, supply) and 40 - lacking[x] >= min(40, supply)
    assert abs(len(chosen) - picked) <= 6
    assert corpus.balance_multilabel(df.limit(0), "id", "labels", 40).count() == 0


def test_line_numbers_over_many_files(spark, tmp_path):
    rows = [(i, f"line {i}\nsecond" if i % 7 else f"{i}" * 50) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, x string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        sinks.write_lines(df, [F.desc("i")], F.col("x"), str(tmp_path / "down"))
        sinks.write_lines(df, ["i"], F.col("i").cast("string"), str(tmp_path / "up"))
        assert len(list((tmp_path / "down").glob("part-*"))) == 13
        down = {r.line_no: r.text for r in readers.numbered_lines(spark, str(tmp_path / "down")).collect()}
        up = {r.line_no: r.text for r in readers.numbered_lines(spark, str(tmp_path / "up")).collect()}
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert up == {i: str(i) for i in range(900)}
    assert down == {899 - i: x.replace("\n", " ") for i, x in rows}
