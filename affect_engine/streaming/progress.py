"""Progress of running jobs from their log lines, in batch and as a stream.

A stage is done once a later stage or the completion line has been seen, so a
job's state is the first line of each stage and the last event line. Those
merge in any order, which keeps the stream right for late and shuffled lines
and lets the batch form be a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.vocab import STAGE_IDS
from ..operators.scan import chunk_of, ordered_scan

# Markers in a job's log.
STAGE_MARK = r"STAGE (\d[AB]?):"
COMPLETE_MARK = r"PIPELINE COMPLETE \(ALL STAGES\)"
FAILED_MARK = r"Pipeline stopped: Stage (\S+) failed"
LOG_PREFIX = r"^\S+ \S+ - (\w+) - [\w.]+ -\s*"
LOG_NOISE = r"^(Pipeline stopped|Traceback \(most recent|\s*File \"|\s*\^+\s*$|\s*at )"
BARE_ERROR = r"^(ERROR:|[A-Za-z]*(Error|Exception)\b|Refusing to start)"
REASON_LENGTH = 400


def parse_events(lines: DataFrame) -> DataFrame:
    """Lines that mean something: event stage, complete or failed, with its stage."""
    line = F.col("line")
    stage = F.regexp_extract(line, STAGE_MARK, 1)
    failed = F.regexp_extract(line, FAILED_MARK, 1)
    event = (
        F.when(stage.isin(list(STAGE_IDS)), "stage")
        .when(line.rlike(COMPLETE_MARK), "complete")
        .when(failed != "", "failed")
    )
    tagged = lines.withColumn("event", event).where(F.col("event").isNotNull())
    return tagged.withColumn(
        "stage", F.when(F.col("event") == "stage", stage).when(F.col("event") == "failed", failed)
    ).drop("line")


def job_progress(lines: DataFrame) -> DataFrame:
    """Current stage, finished stages and progress per job."""
    events = parse_events(lines)
    moves = F.col("event").isin("stage", "complete")
    firsts = events.where("event = 'stage'").groupBy("job_id", "stage").agg(
        F.min("line_no").alias("first_line")
    )
    heads = events.groupBy("job_id").agg(
        F.max(F.when(moves, F.col("line_no"))).alias("last_line"),
        F.max_by("stage", F.when(F.col("event") == "stage", F.col("line_no"))).alias("stage"),
        F.max(F.col("event") == "complete").alias("complete"),
        F.max_by("stage", F.when(F.col("event") == "failed", F.col("line_no"))).alias("failed_stage"),
    )
    done = (
        heads.join(firsts.withColumnRenamed("stage", "__s"), "job_id", "left")
        .groupBy("job_id", "stage", "complete", "failed_stage")
        .agg(F.count_if(F.col("first_line") < F.col("last_line")).alias("stages_done"))
    )
    return done.withColumn("progress", F.col("stages_done") / len(STAGE_IDS))


def final_status(progress: DataFrame, exits: DataFrame) -> DataFrame:
    """Succeeded, cancelled, failed or still running, with the reason."""
    joined = progress.join(exits, "job_id", "left")
    code = F.col("exit_code")
    won = (code == 0) & F.col("complete")
    status = (
        F.when(code.isNull(), "running")
        .when(won, "succeeded")
        .when(code < 0, "cancelled")
        .otherwise("failed")
    )
    stage_error = F.concat(F.lit("stage "), F.col("failed_stage"), F.lit(" failed"))
    code_error = F.when(
        code == 0, "pipeline exited 0 without completing all stages"
    ).otherwise(F.concat(F.lit("pipeline exited with code "), code.cast("string")))
    return joined.select(
        "job_id",
        status.alias("status"),
        F.when(status != "succeeded", F.col("stage")).alias("stage"),
        F.when(won, F.lit(len(STAGE_IDS))).otherwise(F.col("stages_done")).alias("stages_done"),
        F.when(status == "failed", F.coalesce(stage_error, code_error))
        .when(status.isin("running", "cancelled"), stage_error)
        .alias("error"),
    )


def fail_orphans(jobs: DataFrame, alive: DataFrame) -> DataFrame:
    """Jobs left queued or running without a live process have failed."""
    marked = jobs.join(alive.select("job_id").distinct().withColumn("__alive", F.lit(True)), "job_id", "left")
    orphan = F.col("status").isin("queued", "running") & F.col("__alive").isNull()
    return marked.select(
        "job_id",
        F.when(orphan, "failed").otherwise(F.col("status")).alias("status"),
        F.when(orphan, "interrupted by a restart").otherwise(F.col("error")).alias("error"),
    )


def tail(lines: DataFrame, n: int) -> DataFrame:
    """Last n lines of each job; the rank limit applies before the shuffle."""
    latest = Window.partitionBy("job_id").orderBy(F.desc("line_no"))
    return lines.withColumn("__r", F.row_number().over(latest)).where(F.col("__r") <= n).drop("__r")


def stage_changes(lines: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Stage events that differ from the job's stage before them."""
    events = parse_events(lines).where("event = 'stage'").select("job_id", "line_no", "stage")
    seen = ordered_scan(
        events, ["job_id"], ["line_no"], chunk_of(F.col("line_no"), width), lags={"__prev": F.col("stage")}
    )
    return seen.where(F.col("__prev").isNull() | (F.col("__prev") != F.col("stage"))).drop("__prev")


def failure_reason(lines: DataFrame) -> DataFrame:
    """Per job the last real error line, else the last line that looks like one."""
    text = F.trim("line")
    level = F.nullif(F.regexp_extract(text, LOG_PREFIX, 1), F.lit(""))
    kept = lines.where((text != "") & ~text.rlike(LOG_NOISE)).select(
        "job_id", "line_no", level.alias("level"), F.trim(F.regexp_replace(text, LOG_PREFIX, "")).alias("message")
    ).where("message <> ''")
    message = F.col("message")
    strict = F.col("level").isin("ERROR", "CRITICAL") | (
        F.col("level").isNull() & message.rlike(BARE_ERROR)
    )
    strict = F.coalesce(strict, F.lit(False))
    shaped = kept.withColumn("__strict", strict).where(
        F.col("__strict") | message.rlike("(?i)error|failed|exception")
    )
    cut = F.when(
        F.length(message) > REASON_LENGTH, F.concat(F.substring(message, 1, REASON_LENGTH), F.lit("…"))
    ).otherwise(message)
    return shaped.groupBy("job_id").agg(
        F.max_by(cut, F.struct("__strict", "line_no")).alias("reason")
    )


# --- stream ------------------------------------------------------------------

OUTPUT = "job_id long, stage string, complete boolean, failed_stage string, stages_done long, last_line long, orphaned boolean"
STATE = "firsts array<long>, last_move long, stage_line long, stage string, complete boolean, failed_line long, failed_stage string"


def _progress_row(job, known, orphaned: bool) -> pd.DataFrame:
    firsts, last, _, stage, complete, failed_at, failed = known
    return pd.DataFrame(
        {
            "job_id": [job],
            "stage": [stage],
            "complete": [complete],
            "failed_stage": [failed],
            "stages_done": [sum(0 <= f < last for f in firsts)],
            "last_line": [max(last, failed_at)],
            "orphaned": [orphaned],
        }
    )


def _advance(
    key, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None
) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        known = state.get
        state.remove()
        if not known[4] and known[6] is None:
            yield _progress_row(key[0], known, True)
        return
    known = state.get if state.exists else ([-1] * len(STAGE_IDS), -1, -1, None, False, -1, None)
    firsts, last, at, stage, complete, failed_at, failed = known
    firsts = list(firsts)
    for batch in batches:
        for line, event, name in zip(batch["line_no"].tolist(), batch["event"], batch["stage"]):
            if event == "failed":
                if line > failed_at:
                    failed_at, failed = line, name
                continue
            last = max(last, line)
            if event == "complete":
                complete = True
                continue
            i = STAGE_IDS.index(name)
            firsts[i] = line if firsts[i] < 0 else min(firsts[i], line)
            if line > at:
                at, stage = line, name
    known = (firsts, last, at, stage, complete, failed_at, failed)
    state.update(known)
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    yield _progress_row(key[0], known, False)


def stream_progress(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming twin of ``job_progress``: one updated row per job and batch.

    With ``idle_ms`` the state of a job without new lines for so long is dropped;
    one that has neither ended nor failed then gets a last row with ``orphaned``.
    """
    events = parse_events(lines).select("job_id", "line_no", "event", "stage")

    def advance(key, batches, state):
        yield from _advance(key, batches, state, idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("job_id").applyInPandasWithState(advance, OUTPUT, STATE, "update", timeout)
