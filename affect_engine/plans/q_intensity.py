"""Eligibility, thresholds, gate and scoring."""

from pyspark.sql import functions as F

from ..functions.vocab import EMOTION_CLASSES
from ..operators import intensity as I
from ..operators import scoring
from .catalog import query
from .derived import SQL_VIEWS

K = ["video_id"]
KEY = ["video_id", "segment_id"]

SQL_VIEWS["spoken"] = """
SELECT *, CASE WHEN (video_id + segment_id) % 6 = 0 THEN '  ' ELSE text END AS said FROM segments"""


def spoken(t):
    return t.segments.withColumn(
        "said", F.when((F.col("video_id") + F.col("segment_id")) % 6 == 0, "  ").otherwise(F.col("text")))


@query("f1_eligible_segments", """
SELECT video_id, segment_id FROM spoken WHERE has_speech AND NOT is_advertisement AND trim(said) <> ''""")
def _(t):
    return spoken(t).where(I.eligible(F.col("has_speech"), F.col("said"), F.col("is_advertisement"))).select(*KEY)


@query("f2_skip_reason", """
SELECT video_id, segment_id, coalesce(nullif(concat_ws('_', CASE WHEN NOT has_speech THEN 'no_speech' END,
  CASE WHEN is_advertisement THEN 'advertisement' END, CASE WHEN trim(said) = '' THEN 'no_text' END), ''), 'unknown') AS reason FROM spoken""")
def _(t):
    return spoken(t).select(*KEY, I.skip_reason(F.col("has_speech"), F.col("said"), F.col("is_advertisement")).alias("reason"))


@query("f3_translatable", "SELECT video_id, segment_id FROM spoken WHERE said <> '' AND has_speech")
def _(t):
    return I.translatable(spoken(t), "said").select(*KEY)


@query("f4_translated_projection", """
SELECT video_id, segment_id, start, "end", duration, said AS text, has_speech,
  CASE WHEN said <> '' AND has_speech THEN 'en: ' || said ELSE '' END AS text_en FROM spoken""")
def _(t):
    s = spoken(t)
    done = I.translatable(s, "said").select(*KEY, F.concat(F.lit("en: "), "said").alias("text_en"))
    return I.with_translation(s, done, KEY).select(
        *KEY, "start", "end", "duration", F.col("said").alias("text"), "has_speech", "text_en")


MEDIAN = "coalesce(quantile_cont(arousal, 0.5), 0.5)"
for _method, _sql in (
    ("median", f"SELECT video_id, round({MEDIAN}, 6) AS threshold FROM va GROUP BY video_id"),
    ("mean", "SELECT video_id, round(coalesce(avg(arousal), 0.5), 6) AS threshold FROM va GROUP BY video_id"),
    ("percentile_60", "SELECT video_id, round(coalesce(quantile_cont(arousal, 0.6), 0.5), 6) AS threshold FROM va GROUP BY video_id"),
    ("mad", f"""SELECT video_id, round(coalesce(max(m) + quantile_cont(abs(arousal - m), 0.5), 0.5), 6) AS threshold
       FROM (SELECT *, quantile_cont(arousal, 0.5) OVER (PARTITION BY video_id) AS m FROM va) GROUP BY video_id"""),
):
    query(f"a1_threshold_{_method}", _sql)(
        lambda t, m=_method: I.thresholds(t.va_keys, K, "arousal", m).withColumn("threshold", F.round("threshold", 6)))

SQL_VIEWS["flagged"] = """
SELECT *, coalesce(arousal > threshold, false) AS significant FROM va
JOIN (SELECT video_id, coalesce(quantile_cont(arousal, 0.5), 0.5) AS threshold FROM va GROUP BY video_id) USING (video_id)"""


@query("w1_significance_and_percentile", """
SELECT video_id, segment_id, significant AS is_emotionally_significant,
  CASE WHEN arousal IS NOT NULL THEN round(threshold, 6) END AS threshold_used,
  CASE WHEN arousal IS NOT NULL THEN round_even((SELECT count(*) FROM va b WHERE b.video_id = a.video_id AND b.arousal < a.arousal) * 100.0::DOUBLE
    / (SELECT count(arousal) FROM va b WHERE b.video_id = a.video_id), 1) END AS arousal_percentile
FROM flagged a""")
def _(t):
    return I.flag_significant(t.va_keys, K, "arousal").select(
        *KEY, "is_emotionally_significant", F.round("threshold_used", 6).alias("threshold_used"), "arousal_percentile")


@query("a2_score_statistics", """
SELECT video_id, round(coalesce(avg(arousal), 0), 6) AS mean, round(coalesce(stddev_pop(arousal), 0), 6) AS std,
  coalesce(min(arousal), 0) AS min, coalesce(max(arousal), 0) AS max,
  round(coalesce(quantile_cont(arousal, 0.1), 0), 6) AS p10, round(coalesce(quantile_cont(arousal, 0.25), 0), 6) AS p25,
  round(coalesce(quantile_cont(arousal, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(arousal, 0.75), 0), 6) AS p75,
  round(coalesce(quantile_cont(arousal, 0.9), 0), 6) AS p90 FROM va GROUP BY video_id""")
def _(t):
    s = I.score_statistics(t.va_keys, K, "arousal")
    return s.select("video_id", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p10", "p25", "p50", "p75", "p90")])


@query("a3_score_correlation", """
SELECT video_id, round(CASE WHEN count(arousal) > 1 THEN CASE WHEN stddev_pop(arousal) * stddev_pop(valence) > 1e-16
  THEN covar_pop(arousal, valence) / (stddev_pop(arousal) * stddev_pop(valence)) END ELSE 0.0 END, 6) AS correlation
FROM va GROUP BY video_id""")
def _(t):
    r = I.correlation(F.col("arousal"), F.col("valence"))
    return t.va_keys.groupBy("video_id").agg(
        F.round(F.when(F.count("arousal") > 1, r).otherwise(0.0), 6).alias("correlation"))


@query("a4_segment_counts", """
SELECT video_id, count(*) AS total_segments, count(*) FILTER (has_speech) AS segments_with_speech,
  count(*) FILTER (trim(text) <> '') AS segments_with_text, count(*) FILTER (is_advertisement) AS advertisement_segments,
  count(arousal) AS classified_segments, count(*) - count(arousal) AS skipped_segments,
  count(*) FILTER (significant) AS significant_count,
  round(coalesce(count(*) FILTER (significant) * 100.0::DOUBLE / nullif(count(arousal), 0), 0), 6) AS significant_percentage
FROM flagged GROUP BY video_id""")
def _(t):
    keys = t.va_keys.withColumn("is_advertisement", (F.col("video_id") + F.col("segment_id")) % 13 == 0)
    out = I.segment_counts(I.flag_significant(keys, K, "arousal"), K)
    return out.withColumn("significant_percentage", F.round("significant_percentage", 6))


SQL_VIEWS["gated"] = """
SELECT f.video_id, f.segment_id, significant AND EXISTS (SELECT 1 FROM flagged g WHERE g.video_id = f.video_id AND g.significant AND g.has_speech) AS sig,
  CASE WHEN hit THEN distil_label ELSE 'neutral' END AS predicted_emotion,
  CASE WHEN hit THEN distil_confidence ELSE 1.0 END AS confidence,
  CASE WHEN hit THEN 'model' ELSE 'intensity_filter' END AS classification_method
FROM (SELECT *, significant AND has_speech AND distil_label IS NOT NULL AS hit FROM flagged JOIN predictions USING (video_id, segment_id)) f"""


def gated(t):
    flagged = I.flag_significant(t.va_keys, K, "arousal")
    base = t.va_keys.select(*KEY, "text", "has_speech")
    p = t.predictions.where("distil_label is not null").select(
        *KEY, F.col("distil_label").alias("label"), F.col("distil_confidence").alias("confidence"),
        F.lit(None).cast("map<string,double>").alias("probabilities"))
    return I.merge_gated(I.gate(base, flagged, KEY), p, KEY, K)


@query("f5_significance_gate", """
SELECT video_id, segment_id, sig AS is_emotionally_significant, predicted_emotion, confidence, classification_method FROM gated""")
def _(t):
    return gated(t).select(*KEY, "is_emotionally_significant", "predicted_emotion", "confidence", "classification_method")


@query("j2_emotion_with_arousal", """
SELECT video_id, segment_id, distil_label AS label, arousal FROM predictions LEFT JOIN va USING (video_id, segment_id) WHERE distil_label IS NOT NULL""")
def _(t):
    va = t.va_keys.select(*KEY, "arousal")
    return t.predictions.where("distil_label is not null").join(va, KEY, "left").select(*KEY, F.col("distil_label").alias("label"), "arousal")


@query("a5_emotion_distribution", """
SELECT video_id, predicted_emotion, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / any_value(total), 1) AS percentage,
  round(coalesce(any_value(mean), 0), 6) AS average_confidence_classified
FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS total, avg(CASE WHEN classification_method = 'model' THEN confidence END) OVER (PARTITION BY video_id) AS mean FROM gated)
GROUP BY video_id, predicted_emotion""")
def _(t):
    return I.emotion_distribution(gated(t), K).withColumn(
        "average_confidence_classified", F.round("average_confidence_classified", 6))


@query("a26_intensity_levels", """
SELECT least(floor(arousal * 5 + 1e-9), 4)::INT + 1 AS level, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
FROM va WHERE arousal IS NOT NULL GROUP BY level""")
def _(t):
    scored = t.va_keys.where("arousal is not null")
    total = scored.agg(F.count("*").alias("total"))
    counts = scored.groupBy(I.intensity_level(F.col("arousal")).alias("level")).agg(F.count("*").alias("n"))
    # One row.
    return counts.join(F.broadcast(total), how="cross").select(
        "level", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("a26_range_inside_label", """
SELECT video_id, distil_label, round(max(valence) - min(valence), 6) AS label_range, count(*) AS n, round(any_value(g), 6) AS group_range,
  round((max(valence) - min(valence)) / nullif(any_value(g), 0), 6) AS share_of_range
FROM (SELECT *, max(valence) OVER (PARTITION BY video_id) - min(valence) OVER (PARTITION BY video_id) AS g
      FROM va JOIN predictions USING (video_id, segment_id) WHERE distil_label IS NOT NULL AND valence IS NOT NULL) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY video_id, distil_label"))
def _(t):
    both = t.va_keys.where("valence is not null").join(t.predictions.where("distil_label is not null"), KEY)
    out = I.range_inside_label(both, K, "distil_label", "valence")
    return out.select("video_id", "distil_label", "n", *[F.round(c, 6).alias(c) for c in ("label_range", "group_range", "share_of_range")])


def load_va():
    return scoring.lexicon_va


@query("u1_valence_arousal_scoring", """
SELECT video_id, segment_id, CASE WHEN has_speech THEN ((length(text)*7) % 1000)/1000.0::DOUBLE END AS valence,
  CASE WHEN has_speech THEN ((length(text)*13) % 1000)/1000.0::DOUBLE END AS arousal FROM segments""")
def _(t):
    scorer = scoring.batch_scorer(load_va, scoring.VALENCE_AROUSAL)
    out = scoring.score_distinct(t.va_keys.select(*KEY, "text", "has_speech"), "text", scorer, F.col("has_speech"))
    return out.select(*KEY, "score.valence", "score.arousal")


def load_emotion():
    classes = list(EMOTION_CLASSES)

    def score(texts):
        out = []
        for x in texts:
            best = classes[len(x) % 7]
            out.append((best, 0.5 + (len(x) % 5) / 10.0, {c: float(c == best) for c in classes}))
        return out

    return score


@query("u2_emotion_scoring", """
SELECT video_id, segment_id, ['anger','disgust','fear','joy','neutral','sadness','surprise'][length(x) % 7 + 1] AS label,
  round(0.5 + (length(x) % 5)/10.0, 6) AS confidence FROM (SELECT video_id, segment_id, lower(text) AS x FROM segments)""")
def _(t):
    scorer = scoring.batch_scorer(load_emotion, scoring.EMOTION)
    out = scoring.score_distinct(t.va_keys.select(*KEY, "text"), "text", scorer, transform=F.lower)
    return out.select(*KEY, "score.label", F.round("score.confidence", 6).alias("confidence"))


def load_reverse():
    return lambda texts: [x[::-1] for x in texts]


@query("u3_translation", """
SELECT video_id, segment_id, CASE WHEN text <> '' AND has_speech THEN reverse(text) ELSE '' END AS text_en FROM segments""")
def _(t):
    scorer = scoring.batch_scorer(load_reverse, scoring.TRANSLATION)
    rows = t.va_keys.select(*KEY, "text", "has_speech")
    out = scoring.score_distinct(rows, "text", scorer, (F.col("text") != "") & F.col("has_speech"), out="text_en")
    return out.select(*KEY, F.coalesce("text_en", F.lit("")).alias("text_en"))


def load_vector():
    return lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts]


@query("u4_text_vectors", """
SELECT doc_id, length(text)::DOUBLE AS x, len(regexp_extract_all(text, 'e'))::DOUBLE AS y FROM documents""")
def _(t):
    scorer = scoring.batch_scorer(load_vector, scoring.VECTOR)
    out = scoring.score_distinct(t.documents.select("doc_id", "text"), "text", scorer, out="v")
    return out.select("doc_id", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))


@query("j5_score_distinct_texts", """
SELECT doc_id, ((length(text)*7) % 1000)/1000.0::DOUBLE AS valence, count(*) OVER (PARTITION BY text) AS copies FROM documents""")
def _(t):
    scorer = scoring.batch_scorer(load_va, scoring.VALENCE_AROUSAL)
    docs = t.documents.select("doc_id", "text")
    copies = docs.groupBy("text").agg(F.count("*").alias("copies"))
    scored = copies.withColumn("score", scorer(F.col("text")))
    return docs.join(scored, "text").select("doc_id", "score.valence", "copies")
