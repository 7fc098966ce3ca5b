"""Input tables derived from the driver tables, in Spark and in SQL.

Everything is integer arithmetic on keys and text lengths, so both engines
compute the same inputs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import EMOTION_CLASSES
from ..operators.scan import chunk_of, ordered_scan


def class_at(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in EMOTION_CLASSES]), (index + 1).cast("int"))


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    days = F.unix_date(F.to_date(ts)).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


SQL_CLASSES = "[" + ", ".join(f"'{c}'" for c in EMOTION_CLASSES) + "]"

# Turns per chunk of a recording; seconds per chunk of an event stream.
TURN_CHUNK = 1024
TIME_CHUNK = 3600


class Tables:
    """The driver tables of one scale folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """Documents dealt by id, for costly text work on tables in few files."""
        return self.read("documents").repartition("doc_id")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def segments(self) -> DataFrame:
        base = self.read("conversations").select(
            F.col("conv_id").alias("video_id"),
            F.col("turn").alias("segment_id"),
            "text",
            (1 + F.length("text") % 40).cast("long").alias("seconds"),
            ((F.col("role") != "system") & ((F.col("conv_id") * 7 + F.col("turn")) % 11 != 0)).alias(
                "has_speech"
            ),
            ((F.col("conv_id") + F.col("turn")) % 13 == 0).alias("is_advertisement"),
        )
        placed = ordered_scan(
            base,
            ["video_id"],
            ["segment_id"],
            chunk_of(F.col("segment_id"), TURN_CHUNK),
            sums={"before": F.col("seconds")},
        )
        return placed.select(
            "video_id",
            "segment_id",
            "text",
            F.col("before").cast("double").alias("start"),
            (F.col("before") + F.col("seconds")).cast("double").alias("end"),
            F.col("seconds").cast("double").alias("duration"),
            "has_speech",
            "is_advertisement",
        )

    @cached_property
    def va(self) -> DataFrame:
        """Valence and arousal per segment; null where nothing was scored."""
        return self._va_from(self.segments, "start", "end", "duration", "is_advertisement")

    @cached_property
    def va_keys(self) -> DataFrame:
        """As ``va`` without the times, so no scan over the recording is needed."""
        base = self.read("conversations").select(
            F.col("conv_id").alias("video_id"),
            F.col("turn").alias("segment_id"),
            "text",
            ((F.col("role") != "system") & ((F.col("conv_id") * 7 + F.col("turn")) % 11 != 0)).alias(
                "has_speech"
            ),
        )
        return self._va_from(base)

    def _va_from(self, df: DataFrame, *extra: str) -> DataFrame:
        v, s, n = F.col("video_id"), F.col("segment_id"), F.length("text")
        return df.select(
            "video_id",
            "segment_id",
            "text",
            "has_speech",
            F.when(F.col("has_speech"), ((v * 37 + s * 101 + n) % 1000) / 1000.0).alias("arousal"),
            F.when(F.col("has_speech"), ((v * 53 + s * 17 + n * 3) % 1000) / 1000.0).alias(
                "valence"
            ),
            *extra,
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """One row per segment; label and confidence of three models, some absent."""
        c = self.read("conversations")
        v, s, n = F.col("conv_id"), F.col("turn"), F.length("text")
        distil = (v * 3 + s * 5 + n) % 7
        deberta = (v * 3 + s * 5 + n * 2) % 7
        ru = (distil + F.when((v + s) % 5 == 0, 1).otherwise(0)) % 7
        ru_label = class_at(ru)
        shared = ((v * 33 + s * 35 + 13) % 750 + 250) / 1000.0
        return c.select(
            v.alias("video_id"),
            s.alias("segment_id"),
            F.when(
                (v + s * 2) % 19 != 0,
                F.when((ru_label == "joy") & (s % 2 == 0), "enthusiasm").otherwise(ru_label),
            ).alias("ru_label"),
            F.when((v + s * 2) % 19 != 0, shared).alias("ru_confidence"),
            F.when((v + s * 3) % 13 != 0, class_at(distil)).alias("distil_label"),
            F.when((v + s * 3) % 13 != 0, shared).alias("distil_confidence"),
            F.when(
                (v * 2 + s) % 17 != 0,
                F.when((v * 13 + s * 3) % 23 == 0, "Love").otherwise(class_at(deberta)),
            ).alias("deberta_label"),
            F.when(
                (v * 2 + s) % 17 != 0, ((v * 33 + s * 35 + n + 13) % 750 + 250) / 1000.0
            ).alias("deberta_confidence"),
        )

    @cached_property
    def evals(self) -> DataFrame:
        docs = self.read("documents").select("doc_id", "text", "lang", "source")
        marks = self.read("labels")
        d, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
        true = (d + q) % 7
        wrong = (d * 7 + t) % 5 == 0
        return docs.join(marks, "doc_id").select(
            "doc_id",
            "text",
            "lang",
            "source",
            class_at(true).alias("true_label"),
            class_at((true + F.when(wrong, 1).otherwise(0)) % 7).alias("pred_label"),
            (((d * 33 + 13) % 750 + 250) / 1000.0).alias("confidence"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        d, q = F.col("doc_id"), F.col("quality")
        return self.read("labels").select(
            "doc_id",
            "quality",
            "toxic",
            ((d * 61) % 997 / 997.0 * 0.5 + q * 0.4).alias("p"),
            ((d * 61) % 97 / 97.0 * 0.5 + q * 0.4).alias("pred"),
            ((d * 29) % 89 / 89.0 * 0.6 + q * 0.3).alias("truth"),
        )

    @cached_property
    def corpus(self) -> DataFrame:
        d = F.col("doc_id")
        second = F.when(d % 3 == 0, F.concat(F.lit(", '"), class_at((d * 5) % 7), F.lit("'"))).otherwise("")
        return self.read("documents").select(
            d.alias("row_id"),
            "text",
            "lang",
            class_at(d % 7).alias("label"),
            "source",
            F.concat(F.lit("['"), class_at((d * 3) % 7), F.lit("'"), second, F.lit("]")).alias(
                "labels_source"
            ),
            F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("token_count"),
        )

    @cached_property
    def words(self) -> DataFrame:
        """The timed word stream of every recording."""
        w = self.segments.select(
            "video_id", "segment_id", "start", "duration", F.split("text", " ").alias("ws")
        )
        return w.select(
            "video_id",
            "segment_id",
            F.size("ws").alias("n"),
            "start",
            "duration",
            F.posexplode("ws").alias("i", "word"),
        ).select(
            "video_id",
            "segment_id",
            F.col("i").cast("long").alias("i"),
            "word",
            (F.col("start") + F.col("i") * F.col("duration") / F.col("n")).alias("start"),
            (F.col("start") + (F.col("i") + 1) * F.col("duration") / F.col("n")).alias("end"),
            ((F.col("i") * 29) % 100 / 100.0).alias("probability"),
        )

    @cached_property
    def shots(self) -> DataFrame:
        e = self.read("events").select(
            F.col("user_id").alias("video_id"),
            "event_id",
            epoch_seconds("ts").alias("sec"),
        )
        first = e.groupBy("video_id").agg(F.min("sec").alias("first_sec"))
        timed = e.join(first, "video_id").withColumn("offset", F.col("sec") - F.col("first_sec"))
        scanned = ordered_scan(
            timed,
            ["video_id"],
            ["sec", "event_id"],
            chunk_of(F.col("sec"), TIME_CHUNK),
            position="pos",
            leads={"next_offset": F.col("offset")},
        )
        start = F.col("offset") / 1000.0
        shifted = F.col("next_offset") / 1000.0 - F.col("event_id") % 13
        return scanned.select(
            "video_id",
            (F.col("pos") - 1).alias("scene_id"),
            start.alias("start"),
            F.greatest(start, F.coalesce(shifted, start + 5)).alias("end"),
        ).withColumn("duration", F.col("end") - F.col("start"))

    @cached_property
    def frames(self) -> DataFrame:
        e = self.read("events").select(
            F.col("user_id").alias("track"), "event_id", "ts", (F.col("value") / 1000.0).alias("rms")
        )
        return ordered_scan(
            e,
            ["track"],
            ["ts", "event_id"],
            chunk_of(epoch_seconds("ts"), TIME_CHUNK),
            position="pos",
        ).select("track", (F.col("pos") - 1).alias("i"), "rms")

    @cached_property
    def pairs(self) -> DataFrame:
        d = self.read("documents")
        en = d.select("doc_id", F.col("text").alias("en"))
        ru = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ru"))
        return en.join(ru, "doc_id").select(F.col("doc_id").alias("pair_id"), "en", "ru")

    @cached_property
    def experiments(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.read("orders").select(
            k.alias("iteration_id"),
            F.concat(F.lit("m"), (F.col("o_custkey") % 20).cast("string")).alias("model_name"),
            F.col("o_orderpriority").alias("model_type"),
            (k % 1000 / 1000.0).alias("f1_macro"),
            ((k * 7) % 1000 / 1000.0).alias("accuracy"),
        )

    @cached_property
    def job_log(self) -> DataFrame:
        """Log lines per job; line numbers follow the event id."""
        k = F.col("event_id")
        stage = F.element_at(
            F.array(*[F.lit(s) for s in ("1", "2", "3", "4", "5A", "5B", "6A", "6B", "7A", "7B", "8", "9")]),
            (k % 12 + 1).cast("int"),
        )
        line = (
            F.when(F.col("event_type") == "error", F.concat(F.lit("2026-01-01 10:00:00 - ERROR - a.b - broken input "), k))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("Pipeline stopped: Stage "), stage, F.lit(" failed")))
            .when((F.col("event_type") == "signup") & (k % 3 == 0), F.lit("PIPELINE COMPLETE (ALL STAGES)"))
            .when(k % 5 == 0, F.concat(F.lit("about STAGE "), stage, F.lit(" in prose")))
            .otherwise(F.concat(F.lit("STAGE "), stage, F.lit(": RUN")))
        )
        return self.read("events").select(
            F.col("user_id").alias("job_id"), k.alias("line_no"), "ts", line.alias("line")
        )


SQL_VIEWS = {
    "segments": """
SELECT video_id, segment_id, text, before::DOUBLE AS start, (before + seconds)::DOUBLE AS "end",
       seconds::DOUBLE AS duration, has_speech, is_advertisement
FROM (SELECT conv_id AS video_id, turn AS segment_id, text, 1 + length(text) % 40 AS seconds,
             coalesce(sum(1 + length(text) % 40) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             role <> 'system' AND (conv_id * 7 + turn) % 11 <> 0 AS has_speech,
             (conv_id + turn) % 13 = 0 AS is_advertisement
      FROM conversations)""",
    "va": """
SELECT video_id, segment_id, text, has_speech, start, "end", duration, is_advertisement,
       CASE WHEN has_speech THEN ((video_id*37 + segment_id*101 + length(text)) % 1000)/1000.0::DOUBLE END AS arousal,
       CASE WHEN has_speech THEN ((video_id*53 + segment_id*17 + length(text)*3) % 1000)/1000.0::DOUBLE END AS valence
FROM segments""",
    "predictions": f"""
SELECT video_id, segment_id,
  CASE WHEN (v + s*2) % 19 <> 0 THEN CASE WHEN rl = 'joy' AND s % 2 = 0 THEN 'enthusiasm' ELSE rl END END AS ru_label,
  CASE WHEN (v + s*2) % 19 <> 0 THEN shared END AS ru_confidence,
  CASE WHEN (v + s*3) % 13 <> 0 THEN {SQL_CLASSES}[distil + 1] END AS distil_label,
  CASE WHEN (v + s*3) % 13 <> 0 THEN shared END AS distil_confidence,
  CASE WHEN (v*2 + s) % 17 <> 0 THEN CASE WHEN (v*13 + s*3) % 23 = 0 THEN 'Love' ELSE {SQL_CLASSES}[deberta + 1] END END AS deberta_label,
  CASE WHEN (v*2 + s) % 17 <> 0 THEN ((v*33 + s*35 + n + 13) % 750 + 250)/1000.0::DOUBLE END AS deberta_confidence
FROM (SELECT *, {SQL_CLASSES}[(distil + CASE WHEN (v + s) % 5 = 0 THEN 1 ELSE 0 END) % 7 + 1] AS rl,
             ((v*33 + s*35 + 13) % 750 + 250)/1000.0::DOUBLE AS shared
      FROM (SELECT conv_id AS video_id, turn AS segment_id, conv_id AS v, turn AS s, length(text) AS n,
                   (conv_id*3 + turn*5 + length(text)) % 7 AS distil,
                   (conv_id*3 + turn*5 + length(text)*2) % 7 AS deberta FROM conversations))""",
    "evals": f"""
SELECT doc_id, text, lang, source, {SQL_CLASSES}[t + 1] AS true_label,
       {SQL_CLASSES}[(t + CASE WHEN (doc_id*7 + toxic) % 5 = 0 THEN 1 ELSE 0 END) % 7 + 1] AS pred_label,
       ((doc_id*33 + 13) % 750 + 250)/1000.0::DOUBLE AS confidence
FROM (SELECT doc_id, text, lang, source, toxic, (doc_id + quality) % 7 AS t FROM documents JOIN labels USING (doc_id))""",
    "scores": """
SELECT doc_id, quality, toxic,
       ((doc_id*61) % 997)::DOUBLE / 997.0::DOUBLE * 0.5::DOUBLE + quality * 0.4::DOUBLE AS p,
       ((doc_id*61) % 97)::DOUBLE / 97.0::DOUBLE * 0.5::DOUBLE + quality * 0.4::DOUBLE AS pred,
       ((doc_id*29) % 89)::DOUBLE / 89.0::DOUBLE * 0.6::DOUBLE + quality * 0.3::DOUBLE AS truth
FROM labels""",
    "corpus": f"""
SELECT doc_id AS row_id, text, lang, {SQL_CLASSES}[doc_id % 7 + 1] AS label, source,
       '[''' || {SQL_CLASSES}[(doc_id*3) % 7 + 1] || '''' ||
         CASE WHEN doc_id % 3 = 0 THEN ', ''' || {SQL_CLASSES}[(doc_id*5) % 7 + 1] || '''' ELSE '' END || ']' AS labels_source,
       len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w : w <> '')) AS token_count
FROM documents""",
    "words": """
SELECT video_id, segment_id, i, ws[i + 1] AS word, start + i * duration / n AS start,
       start + (i + 1) * duration / n AS "end", ((i*29) % 100)/100.0::DOUBLE AS probability
FROM (SELECT video_id, segment_id, start, duration, string_split(text, ' ') AS ws,
             len(string_split(text, ' ')) AS n,
             unnest(range(len(string_split(text, ' ')))) AS i FROM segments)""",
    "shots": """
SELECT video_id, scene_id, start, "end", "end" - start AS duration
FROM (SELECT video_id, scene_id, off/1000.0::DOUBLE AS start,
             greatest(off/1000.0::DOUBLE, coalesce(noff/1000.0::DOUBLE - event_id % 13, off/1000.0::DOUBLE + 5)) AS "end"
      FROM (SELECT video_id, event_id, row_number() OVER w - 1 AS scene_id, off, lead(off) OVER w AS noff
            FROM (SELECT user_id AS video_id, event_id, sec, sec - min(sec) OVER (PARTITION BY user_id) AS off
                  FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS sec FROM events))
            WINDOW w AS (PARTITION BY video_id ORDER BY sec, event_id)))""",
    "frames": """
SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
       value/1000.0::DOUBLE AS rms FROM events""",
    "pairs": """
SELECT a.doc_id AS pair_id, a.text AS en, b.text AS ru
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""",
    "experiments": """
SELECT o_orderkey AS iteration_id, 'm' || (o_custkey % 20) AS model_name, o_orderpriority AS model_type,
       (o_orderkey % 1000)/1000.0::DOUBLE AS f1_macro, ((o_orderkey*7) % 1000)/1000.0::DOUBLE AS accuracy FROM orders""",
    "job_log": """
SELECT user_id AS job_id, event_id AS line_no, ts,
  CASE WHEN event_type = 'error' THEN '2026-01-01 10:00:00 - ERROR - a.b - broken input ' || event_id
       WHEN event_type = 'purchase' THEN 'Pipeline stopped: Stage ' || stage || ' failed'
       WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'PIPELINE COMPLETE (ALL STAGES)'
       WHEN event_id % 5 = 0 THEN 'about STAGE ' || stage || ' in prose'
       ELSE 'STAGE ' || stage || ': RUN' END AS line
FROM (SELECT *, ['1','2','3','4','5A','5B','6A','6B','7A','7B','8','9'][event_id % 12 + 1] AS stage FROM events)""",
}
