"""Job logs, artefacts, manifests, files."""

from pyspark.sql import functions as F

from ..operators import export
from ..session import scratch_path
from ..sources import manifest as MF
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import progress as P
from .catalog import query
from .derived import SQL_VIEWS
from .q_ensemble import aligned

STAGES = "('1','2','3','4','5A','5B','6A','6B','7A','7B','8','9')"
SQL_VIEWS["log_events"] = f"""
SELECT job_id, line_no, CASE WHEN s IN {STAGES} THEN 'stage' WHEN line LIKE '%PIPELINE COMPLETE (ALL STAGES)%' THEN 'complete' WHEN f <> '' THEN 'failed' END AS event,
  CASE WHEN s IN {STAGES} THEN s WHEN line LIKE '%PIPELINE COMPLETE%' THEN NULL WHEN f <> '' THEN f END AS stage
FROM (SELECT *, regexp_extract(line, 'STAGE (\\d[AB]?):', 1) AS s, regexp_extract(line, 'Pipeline stopped: Stage (\\S+) failed', 1) AS f FROM job_log)
WHERE s IN {STAGES} OR line LIKE '%PIPELINE COMPLETE (ALL STAGES)%' OR f <> ''"""
SQL_VIEWS["job_state"] = """
SELECT job_id, max_by(stage, line_no) FILTER (event = 'stage') AS stage, bool_or(event = 'complete') AS complete, max_by(stage, line_no) FILTER (event = 'failed') AS failed_stage,
  (SELECT count(DISTINCT stage) FROM log_events a WHERE a.job_id = e.job_id AND a.event = 'stage' AND a.line_no < (SELECT max(line_no) FROM log_events b WHERE b.job_id = e.job_id AND b.event <> 'failed')) AS stages_done
FROM log_events e GROUP BY job_id"""


@query("r1_log_events", "SELECT job_id, line_no, event, stage FROM log_events")
def _(t):
    return P.parse_events(t.job_log).select("job_id", "line_no", "event", "stage")


@query("r2_job_progress", "SELECT job_id, stage, complete, failed_stage, stages_done, round(stages_done / 12, 6) AS progress FROM job_state")
def _(t):
    return P.job_progress(t.job_log).withColumn("progress", F.round("progress", 6))


def run_stream(t):
    """Drive the streaming form over the whole event table and keep each job's last row."""
    spark = t.spark
    path = f"{t.folder.rstrip('/')}/events*.parquet"
    schema = t.events.schema
    stream = type(t)(spark, t.folder)
    stream.read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    out, state = scratch_path(spark, "progress"), scratch_path(spark, "progress-state")

    def keep(batch, number):
        # A repeated batch overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    running = (
        P.stream_progress(stream.job_log)
        .writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    running.awaitTermination()
    rows = spark.read.parquet(out)
    fields = ("stage", "complete", "failed_stage", "stages_done")
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch").alias("r")).select("job_id", "r.*")


@query("r2_streaming_progress", "SELECT job_id, stage, complete, failed_stage, stages_done FROM job_state")
def _(t):
    return run_stream(t)


SQL_VIEWS["job_end"] = """
SELECT job_id, CASE WHEN code IS NULL THEN 'running' WHEN code = 0 AND complete THEN 'succeeded' WHEN code < 0 THEN 'cancelled' ELSE 'failed' END AS status,
  stage AS s, stages_done AS d, failed_stage, code, complete FROM (SELECT *, CASE job_id % 4 WHEN 0 THEN 0 WHEN 1 THEN -15 WHEN 2 THEN 1 END AS code FROM job_state)"""
SQL_VIEWS["job_final"] = """
SELECT job_id, status, CASE WHEN status <> 'succeeded' THEN s END AS stage, CASE WHEN status = 'succeeded' THEN 12 ELSE d END AS stages_done,
  CASE WHEN status = 'failed' THEN coalesce('stage ' || failed_stage || ' failed', CASE WHEN code = 0 THEN 'pipeline exited 0 without completing all stages' ELSE 'pipeline exited with code ' || code END)
       WHEN status IN ('running', 'cancelled') THEN 'stage ' || failed_stage || ' failed' END AS error FROM job_end"""


def finals(t):
    k = F.col("user_id")
    exits = t.events.select(k.alias("job_id")).distinct().select(
        "job_id", F.when(F.col("job_id") % 4 == 0, 0).when(F.col("job_id") % 4 == 1, -15).when(F.col("job_id") % 4 == 2, 1).alias("exit_code"))
    return P.final_status(P.job_progress(t.job_log), exits)


@query("r3_final_status", "SELECT * FROM job_final")
def _(t):
    return finals(t)


@query("r4_orphans_fail", """
SELECT job_id, CASE WHEN status = 'running' AND job_id % 8 <> 3 THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'running' AND job_id % 8 <> 3 THEN 'interrupted by a restart' ELSE error END AS error FROM job_final""")
def _(t):
    alive = t.events.where(F.col("user_id") % 8 == 3).select(F.col("user_id").alias("job_id"))
    return P.fail_orphans(finals(t), alive)


@query("r5_tail", "SELECT job_id, line_no, line FROM job_log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY line_no DESC) <= 7")
def _(t):
    return P.tail(t.job_log.select("job_id", "line_no", "line"), 7)


@query("r6_stage_changes", """
SELECT job_id, line_no, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY line_no) AS prev FROM log_events WHERE event = 'stage') WHERE prev IS NULL OR prev <> stage""")
def _(t):
    return P.stage_changes(t.job_log)


@query("r7_failure_reason", """
SELECT job_id, arg_max(m, (strict, line_no)) AS reason FROM (
  SELECT job_id, line_no, level = 'ERROR' AS strict, m FROM (SELECT job_id, line_no, regexp_extract(line, '^\\S+ \\S+ - (\\w+) - [\\w.]+ -\\s*', 1) AS level,
    regexp_replace(line, '^\\S+ \\S+ - (\\w+) - [\\w.]+ -\\s*', '') AS m FROM job_log WHERE NOT starts_with(line, 'Pipeline stopped')) WHERE level = 'ERROR' OR regexp_matches(lower(m), 'error|failed|exception')) GROUP BY job_id""")
def _(t):
    return P.failure_reason(t.job_log)


# --- artefacts and manifests -------------------------------------------------

SQL_VIEWS["results"] = """
SELECT o_custkey AS video_id, ['1','2','3','4','5A'][o_orderkey % 5 + 1] AS stage, ['success','skipped','failed'][(o_orderkey // 5) % 3 + 1] AS status FROM orders"""


def results(t):
    k = F.col("o_orderkey")
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    return t.orders.select(F.col("o_custkey").alias("video_id"), pick(("1", "2", "3", "4", "5A"), k % 5).alias("stage"),
                           pick(("success", "skipped", "failed"), F.floor(k / 5) % 3).alias("status"))


@query("io10_status_tally", """
SELECT stage, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM results GROUP BY stage""")
def _(t):
    return MF.status_tally(results(t))


@query("a24_outcome_per_recording", """
SELECT video_id, count(*) AS stages, count(*) FILTER (status = 'failed') AS failures, min(stage) FILTER (status = 'failed') AS first_failure FROM results GROUP BY video_id""")
def _(t):
    return MF.outcome_per_recording(results(t))


@query("io9_pending_outputs", """
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderkey % 3 = 0 AND d.o_orderkey = o.o_orderkey - o.o_orderkey % 2
  AND abs((o.o_orderkey % 7)/1000.0 - (d.o_orderkey % 7)/1000.0) <= 0.0010001)""")
def _(t):
    k = F.col("o_orderkey")
    common = [F.lit("6A").alias("stage"), F.lit("m").alias("model"), F.lit("c").alias("config"), (k % 7 / 1000.0).alias("threshold")]
    inputs = t.orders.select(k, (k - k % 2).alias("video_id"), *common)
    done = t.orders.where(k % 3 == 0).select(k.alias("video_id"), *common)
    return MF.pending(inputs, done, 0.0010001).select("o_orderkey")


SQL_VIEWS["artefacts"] = """
SELECT o_orderkey, '/data/video-' || o_custkey || '/' || ['transcription_full_ru_large','arousal_en_base','emotion_ru_small','local_segments_x_translated','notes'][o_orderkey % 5 + 1] || '.json' AS path FROM orders"""


@query("io2_describe_artefacts", """
SELECT o_orderkey, regexp_extract(path, 'video-([^/]+)/', 1) AS video_id, ['transcription','arousal','emotion','local_segments',NULL][o_orderkey % 5 + 1] AS kind,
  CASE WHEN o_orderkey % 5 IN (1, 3) THEN 'en' ELSE 'ru' END AS lang, ['large','base','small',NULL,NULL][o_orderkey % 5 + 1] AS model FROM artefacts""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("transcription_full_ru_large", "arousal_en_base", "emotion_ru_small", "local_segments_x_translated", "notes")])
    path = F.concat(F.lit("/data/video-"), F.col("o_custkey"), F.lit("/"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit(".json"))
    rows = t.orders.select("o_orderkey", path.alias("path"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in RD.describe_artefact(F.col("path")).items()])


@query("io1_stage_documents", """SELECT video_id, segment_id, start, "end", has_speech, text FROM segments""")
def _(t):
    rows = t.segments.select("video_id", "segment_id", "start", "end", "has_speech", "text")
    path = scratch_path(t.spark, "documents")
    SK.as_documents(rows.withColumn("video", F.col("video_id")), "video_id", "segment_id").select("value").write.text(path)
    row = "segment_id long, start double, `end` double, has_speech boolean, text string, video long"
    back = RD.stage_documents(t.spark, path, row, "segments", multi_line=False)
    return back.select(F.col("video").alias("video_id"), "segment_id", "start", "end", "has_speech", "text")


@query("io8_rows_and_statistics", """SELECT video_id, count(*) AS n, max("end") AS total FROM segments GROUP BY video_id""")
def _(t):
    stats = t.segments.groupBy("video_id").agg(F.count("*").alias("n"), F.max("end").alias("total"))
    path = scratch_path(t.spark, "stage")
    SK.write_rows_and_statistics(t.segments, stats, path)
    return t.spark.read.parquet(f"{path}/statistics")


@query("io7_export_csv", """
SELECT video_id, segment_id, emotion_final, emotion_agreement, ru_arousal FROM exported""")
def _(t):
    path = scratch_path(t.spark, "export")
    SK.write_export_csv(export.export_table(aligned(t)), path)
    schema = "video_id long, segment_id long, start_time double, end_time double, duration double, text_ru string, text_en string, " + ", ".join(
        f"{c} double" for c in ("ru_arousal", "ru_valence", "en_arousal", "en_valence")) + ", emotion_ru string, emotion_ru_confidence double, emotion_en_distil string, emotion_en_distil_confidence double, emotion_en_deberta string, emotion_en_deberta_confidence double, emotion_final string, emotion_agreement string"
    back = t.spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return back.select("video_id", "segment_id", "emotion_final", "emotion_agreement", "ru_arousal")


@query("io4_corpus_csv", "SELECT label, source, count(*) AS n, sum(token_count)::BIGINT AS tokens, sum(length(text))::BIGINT AS chars FROM corpus GROUP BY ALL")
def _(t):
    path = scratch_path(t.spark, "corpus")
    t.corpus.select("text", "label", "source", "labels_source", "token_count").write.csv(path, header=True, quote='"', escape='"', compression="gzip", quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = RD.corpus_csv(t.spark, path)
    return back.groupBy("label", "source").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.sum(F.length("text")).alias("chars"))


@query("io5_table_by_suffix", "SELECT count(*) AS n FROM documents WHERE trim(text) <> ''")
def _(t):
    rows = RD.table(t.spark, f"{t.folder.rstrip('/')}/documents.parquet", "parquet", ["doc_id", "text"], at_least=20)
    return rows.agg(F.count("*").alias("n"))


@query("io6_zip_lines", "SELECT doc_id AS line_no, a.text AS en, b.text AS ru FROM documents a JOIN (SELECT doc_id, upper(left(text, 3)) AS text FROM documents WHERE doc_id % 2 = 0) b USING (doc_id)".replace("upper(left(text, 3))", "source"))
def _(t):
    left = t.documents.select(F.col("doc_id").alias("line_no"), "text")
    right = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("line_no"), F.col("source").alias("text"))
    return RD.zip_lines(left, right)


@query("io6_zip_line_files", """
SELECT a.n AS line_no, a.text AS en, b.text AS ru FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents) a
JOIN (SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS n, source || '/' || doc_id AS text FROM documents) b USING (n)""")
def _(t):
    path = scratch_path(t.spark, "lines")
    SK.write_lines(t.documents, ["doc_id"], F.col("text"), f"{path}/en")
    other = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    SK.write_lines(t.documents, [F.desc("doc_id")], other, f"{path}/ru")
    return RD.zip_lines(RD.numbered_lines(t.spark, f"{path}/en"), RD.numbered_lines(t.spark, f"{path}/ru"))


@query("io11_finished_runs", """
SELECT o_custkey AS video_id, max(o_orderkey) AS modified FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def _(t):
    runs = t.orders.select(F.col("o_custkey").alias("video_id")).distinct()
    exports = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("modified"))
    return RD.finished_runs(runs, exports)


@query("io12_transcript_catalog", """
SELECT 'p' || o_orderkey AS path, o_orderstatus AS model, o_orderpriority AS language, o_totalprice AS duration, o_custkey AS total_words, (o_orderkey % 10)/10.0::DOUBLE AS average_confidence FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    documents = t.orders.select(
        F.concat(F.lit("p"), k).alias("path"),
        F.struct(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("language"), F.col("o_totalprice").alias("duration")).alias("metadata"),
        F.struct(F.col("o_custkey").alias("total_words"), (k % 10 / 10.0).alias("average_confidence")).alias("statistics"))
    return RD.transcript_catalog(documents)
