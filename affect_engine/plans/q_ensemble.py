"""Votes, export table, run summaries."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import ensemble, export
from ..operators.scan import chunk_of
from .catalog import query
from .derived import SQL_VIEWS, TURN_CHUNK

CLASSES_SQL = "('anger','disgust','fear','joy','neutral','sadness','surprise')"


def canonical_sql(x: str, default: str) -> str:
    return (
        f"CASE WHEN lower(trim({x})) IN {CLASSES_SQL} THEN lower(trim({x})) "
        f"WHEN lower(trim({x})) IN ('happiness','happy','enthusiasm') THEN 'joy' "
        f"WHEN lower(trim({x})) = 'sad' THEN 'sadness' ELSE {default} END"
    )


def capital_sql(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"


def display_sql(x: str) -> str:
    c = canonical_sql(x, "NULL")
    return (
        f"CASE WHEN ({c}) = 'joy' THEN 'Happiness' WHEN ({c}) IS NOT NULL THEN "
        f"{capital_sql(f'({c})')} ELSE {capital_sql(x)} END"
    )


def long_sql(order: dict[str, int], label: str, source: str = "predictions") -> str:
    return " UNION ALL ".join(
        f"SELECT video_id, segment_id, {i} AS ord, {label.format(m=m)}, "
        f"coalesce({m}_confidence, 0.0) AS conf FROM {source} WHERE {m}_label IS NOT NULL"
        for m, i in order.items()
    )


_RAW = "{m}_label AS raw"
SQL_VIEWS["aligned_predictions"] = """
SELECT * FROM predictions JOIN (
  SELECT video_id, CASE WHEN count(distil_label) > 0 THEN 'distil' WHEN count(deberta_label) > 0 THEN 'deberta' WHEN count(ru_label) > 0 THEN 'ru' END AS reference
  FROM predictions GROUP BY video_id) USING (video_id)
WHERE CASE reference WHEN 'distil' THEN distil_label WHEN 'deberta' THEN deberta_label ELSE ru_label END IS NOT NULL"""


def aligned_predictions(t):
    return ensemble.align_to_reference(t.predictions, ["video_id"])


SQL_VIEWS["tl_long"] = f"""
SELECT video_id, segment_id, ord, conf,
  {canonical_sql('raw', "'neutral'")} AS label, ({canonical_sql('raw', 'NULL')}) IS NOT NULL AS known
FROM ({long_sql(dict(distil=1, deberta=2, ru=3), _RAW, "aligned_predictions")})"""
SQL_VIEWS["timeline"] = """
SELECT video_id, segment_id, emotion, agreement_level, top::BIGINT AS models_agree, n::BIGINT AS total_models,
  (SELECT avg(conf) FROM tl_used u WHERE u.video_id = z.video_id AND u.segment_id = z.segment_id AND u.label = z.emotion) AS confidence,
  CASE agreement_level WHEN 'full' THEN 'ensemble_' || n || '_models_full_agreement'
    WHEN 'majority' THEN 'ensemble_' || top || '_of_' || n || '_agree' ELSE 'ensemble_confidence_weighted' END AS source
FROM (SELECT *, CASE WHEN agreement_level = 'disagreement' THEN confident ELSE winner END AS emotion
      FROM (SELECT *, CASE WHEN top = n AND n > 1 THEN 'full' WHEN top * 2 >= n THEN 'majority' ELSE 'disagreement' END AS agreement_level
            FROM (SELECT video_id, segment_id, first(label ORDER BY votes DESC, ord) AS winner,
                         first(label ORDER BY conf DESC, ord) AS confident, max(votes) AS top, count(*) AS n
                  FROM (SELECT *, count(*) OVER (PARTITION BY video_id, segment_id, label) AS votes FROM tl_used)
                  GROUP BY video_id, segment_id))) z"""
SQL_VIEWS["tl_used"] = """
SELECT * FROM (SELECT *, bool_or(known) OVER (PARTITION BY video_id, segment_id) AS any_known FROM tl_long)
WHERE known OR NOT any_known"""


@query("v1_timeline_vote", """
SELECT video_id, segment_id, emotion, agreement_level, models_agree, total_models,
       round(confidence, 6) AS confidence, source FROM timeline""")
def _(t):
    return ensemble.timeline_vote(aligned_predictions(t)).select(
        "video_id", "segment_id", "emotion", "agreement_level",
        F.col("models_agree").cast("long"), F.col("total_models").cast("long"),
        F.round("confidence", 6).alias("confidence"), "source")


@query("v2_ensemble_affect", """
SELECT video_id, segment_id, round(list_avg(list_filter([
    CASE WHEN distil_label IS NOT NULL THEN coalesce(arousal, 0.5) END, CASE WHEN deberta_label IS NOT NULL THEN coalesce(arousal / 2, 0.5) END,
    CASE WHEN ru_label IS NOT NULL THEN 0.5 END], lambda x : x IS NOT NULL)), 6) AS arousal,
  round(list_avg(list_filter([CASE WHEN distil_label IS NOT NULL THEN coalesce(valence, 0.5) END, CASE WHEN deberta_label IS NOT NULL THEN 0.5 END,
    CASE WHEN ru_label IS NOT NULL THEN coalesce(1 - valence, 0.5) END], lambda x : x IS NOT NULL)), 6) AS valence
FROM aligned_predictions JOIN va USING (video_id, segment_id)""")
def _(t):
    # Three models' readings; each lacks one dimension or another.
    scores = t.va_keys.select(
        "video_id", "segment_id", F.col("arousal").alias("distil_arousal"), (F.col("arousal") / 2).alias("deberta_arousal"),
        F.col("valence").alias("distil_valence"), (1 - F.col("valence")).alias("ru_valence"))
    rows = aligned_predictions(t).join(scores, ["video_id", "segment_id"])
    return ensemble.timeline_vote(rows).select(
        "video_id", "segment_id", F.round("arousal", 6).alias("arousal"), F.round("valence", 6).alias("valence"))


@query("v3_source_counts", "SELECT source, count(*) AS n FROM timeline GROUP BY source")
def _(t):
    return ensemble.timeline_vote(aligned_predictions(t)).groupBy("source").agg(F.count("*").alias("n"))


def export_vote_view(label: str) -> str:
    return f"""
SELECT p.video_id, p.segment_id,
  CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 AND top = 1 THEN confident ELSE winner END AS emotion_final,
  CASE WHEN n IS NULL THEN 'no_data' WHEN n = 1 THEN 'single' WHEN top = n THEN 'full'
       WHEN top >= 2 THEN 'majority' ELSE 'confidence' END AS emotion_agreement
FROM predictions p LEFT JOIN (
  SELECT video_id, segment_id, first(label ORDER BY votes DESC, ord) AS winner,
         first(label ORDER BY conf DESC, ord) AS confident, max(votes) AS top, count(*) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY video_id, segment_id, label) AS votes
        FROM (SELECT video_id, segment_id, ord, conf, {label} AS label
              FROM ({long_sql(dict(ru=1, distil=2, deberta=3), _RAW)})))
  GROUP BY video_id, segment_id) v ON v.video_id = p.video_id AND v.segment_id = p.segment_id"""


SQL_VIEWS["final_vote"] = export_vote_view(canonical_sql("raw", "lower(trim(raw))"))
SQL_VIEWS["raw_vote"] = export_vote_view("lower(trim(raw))")


@query("v4_export_vote", "SELECT * FROM final_vote")
def _(t):
    return ensemble.export_vote(t.predictions).select(
        "video_id", "segment_id", "emotion_final", "emotion_agreement")


@query("v5_plain_majority", """
SELECT video_id, segment_id, first(raw ORDER BY n DESC, raw) AS label FROM (
  SELECT video_id, segment_id, raw, count(*) AS n FROM (
    SELECT video_id, segment_id, ru_label AS raw FROM predictions UNION ALL
    SELECT video_id, segment_id, distil_label FROM predictions UNION ALL
    SELECT video_id, segment_id, deberta_label FROM predictions) WHERE raw IS NOT NULL GROUP BY ALL)
GROUP BY video_id, segment_id""")
def _(t):
    label = ensemble.plain_majority([F.col("ru_label"), F.col("distil_label"), F.col("deberta_label")])
    return t.predictions.select("video_id", "segment_id", label.alias("label")).where("label is not null")


@query("v6_confidence_gate", """
SELECT video_id, segment_id, emotion, round(confidence, 6) AS confidence FROM timeline WHERE round(confidence, 9) >= 0.4""")
def _(t):
    voted = ensemble.timeline_vote(aligned_predictions(t))
    return voted.where(F.round("confidence", 9) >= 0.4).select(
        "video_id", "segment_id", "emotion", F.round("confidence", 6).alias("confidence"))


@query("v7_canonical_against_raw", """
SELECT 'canonical' AS labels, emotion_agreement AS level, count(*) AS n FROM final_vote GROUP BY ALL
UNION ALL SELECT 'raw', emotion_agreement, count(*) FROM raw_vote GROUP BY ALL""")
def _(t):
    return ensemble.agreement_partition(t.predictions)


@query("w3_emotion_changes", """
SELECT video_id, count(*) FILTER (prev <> emotion) AS emotion_changes,
       round(CASE WHEN count(*) > 1 THEN count(*) FILTER (prev <> emotion) * 100.0 / (count(*) - 1) ELSE 0 END, 6) AS change_rate
FROM (SELECT *, lag(emotion) OVER (PARTITION BY video_id ORDER BY segment_id) AS prev FROM timeline) GROUP BY video_id""")
def _(t):
    voted = ensemble.timeline_vote(aligned_predictions(t))
    return ensemble.emotion_changes(
        voted, ["video_id"], "segment_id", "emotion", chunk_of(F.col("segment_id"), TURN_CHUNK)
    ).withColumn("change_rate", F.round("change_rate", 6))


@query("a10_quality_report", """
SELECT video_id, total_segments, "full", majority, disagreement, low_confidence_count, emotion_changes,
  round(avg_confidence, 9) AS avg_confidence, round(agreement_rate, 9) AS agreement_rate,
  round(neutral_pct, 9) AS neutral_pct, round(change_rate, 9) AS change_rate,
  round(agreement_rate*0.4 + avg_confidence*30 + (100 - abs(neutral_pct - 80))*0.2 + (100 - change_rate)*0.1, 9) AS quality_score,
  concat_ws(',', CASE WHEN agreement_rate < 50 THEN 'low_agreement' END,
    CASE WHEN avg_confidence < 0.4 THEN 'low_confidence' END,
    CASE WHEN neutral_pct < 65 OR neutral_pct > 90 THEN 'unusual_neutral_share' END,
    CASE WHEN change_rate > 60 THEN 'high_change_rate' END,
    CASE WHEN low_confidence_count > total_segments * 0.3 THEN 'many_low_confidence' END) AS warnings
FROM (SELECT video_id, count(*) AS total_segments, count(*) FILTER (agreement_level = 'full') AS "full",
   count(*) FILTER (agreement_level = 'majority') AS majority,
   count(*) FILTER (agreement_level = 'disagreement') AS disagreement,
   avg(confidence) AS avg_confidence, count(*) FILTER (confidence < 0.3) AS low_confidence_count,
   count(*) FILTER (prev <> emotion) AS emotion_changes,
   count(*) FILTER (agreement_level <> 'disagreement') * 100.0::DOUBLE / count(*) AS agreement_rate,
   count(*) FILTER (emotion = 'neutral') * 100.0::DOUBLE / count(*) AS neutral_pct,
   CASE WHEN count(*) > 1 THEN count(*) FILTER (prev <> emotion) * 100.0::DOUBLE / (count(*) - 1) ELSE 0 END AS change_rate
  FROM (SELECT *, lag(emotion) OVER (PARTITION BY video_id ORDER BY segment_id) AS prev FROM timeline) GROUP BY video_id)""")
def _(t):
    voted = ensemble.timeline_vote(aligned_predictions(t))
    q = ensemble.quality_report(voted, ["video_id"], "segment_id", chunk_of(F.col("segment_id"), TURN_CHUNK))
    return q.select(
        "video_id", "total_segments", "full", "majority", "disagreement", "low_confidence_count",
        "emotion_changes",
        *[F.round(c, 9).alias(c) for c in ("avg_confidence", "agreement_rate", "neutral_pct", "change_rate")],
        F.round("quality_score", 9).alias("quality_score"),
        F.array_join("warnings", ",").alias("warnings"))


def aligned(t):
    va = t.va_keys
    ru = va.select("video_id", "segment_id", "arousal", "valence")
    en = va.select("video_id", "segment_id",
                   (1 - F.col("arousal")).alias("arousal"), (1 - F.col("valence")).alias("valence"))
    translated = t.conversations.where((F.col("conv_id") + F.col("turn")) % 7 != 0).select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("segment_id"), F.lower("text").alias("en"))
    p = t.predictions
    sides = {"ru": ru, "en": en, "text": translated}
    for m in ("ru", "distil", "deberta"):
        sides[f"{m}_emotion"] = p.where(F.col(f"{m}_label").isNotNull()).select(
            "video_id", "segment_id", F.col(f"{m}_label").alias("label"),
            F.col(f"{m}_confidence").alias("confidence"))
    base = t.segments.select("video_id", "segment_id", "start", "end", "duration", "text")
    out = export.align_stages(base, ["video_id", "segment_id"], sides)
    return out.withColumnsRenamed({
        f"{m}_emotion_{c}": f"{m}_{c}" for m in ("ru", "distil", "deberta") for c in ("label", "confidence")})


SQL_VIEWS["exported"] = f"""
SELECT s.video_id, s.segment_id, s.start AS start_time, s."end" AS end_time, s.duration, trim(s.text, ' ') AS text_ru,
  CASE WHEN (s.video_id + s.segment_id) % 7 <> 0 THEN trim(lower(s.text), ' ') ELSE '' END AS text_en,
  v.arousal AS ru_arousal, v.valence AS ru_valence, 1 - v.arousal AS en_arousal, 1 - v.valence AS en_valence,
  CASE WHEN p.ru_label IS NULL THEN '' ELSE {display_sql('p.ru_label')} END AS emotion_ru, p.ru_confidence AS emotion_ru_confidence,
  CASE WHEN p.distil_label IS NULL THEN '' ELSE {display_sql('p.distil_label')} END AS emotion_en_distil, p.distil_confidence AS emotion_en_distil_confidence,
  CASE WHEN p.deberta_label IS NULL THEN '' ELSE {display_sql('p.deberta_label')} END AS emotion_en_deberta, p.deberta_confidence AS emotion_en_deberta_confidence,
  {display_sql('f.emotion_final')} AS emotion_final, f.emotion_agreement
FROM segments s JOIN va v USING (video_id, segment_id) JOIN predictions p USING (video_id, segment_id)
JOIN final_vote f USING (video_id, segment_id)"""


@query("j3_export_table", """
SELECT video_id, segment_id, start_time, end_time, duration, text_ru, text_en, ru_arousal, ru_valence,
  round(en_arousal, 6) AS en_arousal, round(en_valence, 6) AS en_valence, emotion_ru, emotion_ru_confidence,
  emotion_en_distil, emotion_en_distil_confidence, emotion_en_deberta, emotion_en_deberta_confidence,
  emotion_final, emotion_agreement FROM exported""")
def _(t):
    out = export.export_table(aligned(t))
    return out.withColumn("en_arousal", F.round("en_arousal", 6)).withColumn(
        "en_valence", F.round("en_valence", 6))


@query("j4_reference_alignment", """
SELECT video_id, segment_id, reference,
  (distil_label IS NOT NULL)::INT + (deberta_label IS NOT NULL)::INT + (ru_label IS NOT NULL)::INT AS models
FROM aligned_predictions""")
def _(t):
    present = [F.col(f"{m}_label").isNotNull().cast("int") for m in ensemble.TIMELINE_MODELS]
    return aligned_predictions(t).select("video_id", "segment_id", "reference", sum(present[1:], present[0]).alias("models"))


@query("a9_completeness", """
SELECT video_id, count(*) AS total_rows,
  count(*) FILTER (text_ru <> '' AND text_en <> '' AND emotion_ru <> '' AND emotion_en_distil <> '' AND emotion_en_deberta <> '') AS complete_rows,
  round_even(count(*) FILTER (text_ru <> '' AND text_en <> '' AND emotion_ru <> '' AND emotion_en_distil <> '' AND emotion_en_deberta <> '') * 100.0::DOUBLE / count(*), 1) AS complete_percentage
FROM exported GROUP BY video_id""")
def _(t):
    return export.completeness(export.export_table(aligned(t)))


@query("a9_agreement_breakdown", """
SELECT video_id, emotion_agreement, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY video_id), 1) AS percentage
FROM exported GROUP BY video_id, emotion_agreement""")
def _(t):
    return export.agreement_counts(ensemble.export_vote(t.predictions))


@query("a11_run_summary", f"""
SELECT video_id, count(*) AS segments, max(end_time) AS duration_seconds,
  round(count(*) FILTER (e = 'neutral')::DOUBLE / count(*) FILTER (e <> ''), 6) AS neutral_share,
  concat_ws(',', {', '.join(f"CASE WHEN count(*) FILTER (emotion_agreement = '{a}') > 0 THEN '{a}=' || count(*) FILTER (emotion_agreement = '{a}') END" for a in ('confidence','full','majority','no_data','single'))}) AS agreement,
  concat_ws(',', {', '.join(f"CASE WHEN count(*) FILTER (e = '{a}') > 0 THEN '{a}=' || count(*) FILTER (e = '{a}') END" for a in ('anger','disgust','fear','joy','neutral','sadness','surprise'))}) AS emotions
FROM (SELECT *, {canonical_sql('emotion_final', "''")} AS e FROM exported) GROUP BY video_id""")
def _(t):
    s = export.run_summary(export.read_back(export.export_table(aligned(t))))

    def flat(c):
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return s.select("video_id", "segments", "duration_seconds",
                    F.round("neutral_share", 6).alias("neutral_share"),
                    flat("agreement").alias("agreement"), flat("emotions").alias("emotions"))


@query("a12_per_model_counts", " UNION ALL ".join(f"""
SELECT video_id, '{m}' AS model, {', '.join(f"count(*) FILTER (e = '{c}') AS {c}" for c in ('anger','disgust','fear','joy','neutral','sadness','surprise'))}
FROM (SELECT video_id, {canonical_sql(c2, "''")} AS e FROM exported) GROUP BY video_id"""
    for m, c2 in (("ru", "emotion_ru"), ("distil", "emotion_en_distil"), ("deberta", "emotion_en_deberta"))))
def _(t):
    rows = export.read_back(export.export_table(aligned(t)))
    return export.per_model_counts(rows, {"ru": "emotion_ru", "distil": "emotion_en_distil", "deberta": "emotion_en_deberta"})


@query("f8_segment_search", f"""
SELECT video_id, segment_id, emotion_agreement AS agreement FROM exported
WHERE {canonical_sql('emotion_final', "''")} = 'joy' AND emotion_agreement = 'majority'
  AND contains(lower(text_ru || ' ' || text_en), 'en')""")
def _(t):
    rows = export.read_back(export.export_table(aligned(t)))
    return export.search(rows, "joy", "majority", "en").select("video_id", "segment_id", "agreement")


@query("f9_label_differs", f"""
SELECT video_id, segment_id, ru_label AS raw,
  lower(ru_label) <> ({canonical_sql('ru_label', "''")}) AND lower(ru_label) <> lower({display_sql('ru_label')}) AS differs
FROM predictions WHERE ru_label IS NOT NULL""")
def _(t):
    p = t.predictions.where("ru_label is not null")
    return p.select("video_id", "segment_id", F.col("ru_label").alias("raw"),
                    export.label_differs(F.col("ru_label"), L.canonicalize(F.col("ru_label"), F.lit(""))).alias("differs"))


@query("s1_ranked_emotions", f"""
SELECT e AS emotion, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, e) AS rank
FROM (SELECT {canonical_sql('emotion_final', 'NULL')} AS e FROM final_vote) WHERE e IS NOT NULL GROUP BY e""")
def _(t):
    return export.ranked_emotions(ensemble.export_vote(t.predictions))


@query("s2_first_page", f"""
SELECT video_id, segment_id, emotion_final FROM exported WHERE emotion_agreement = 'full'
ORDER BY video_id, segment_id LIMIT 25""")
def _(t):
    voted = ensemble.export_vote(t.predictions).where("emotion_agreement = 'full'")
    shown = voted.select("video_id", "segment_id", L.display(F.col("emotion_final")).alias("emotion_final"))
    return export.first_page(shown, ["video_id", "segment_id"])


@query("t16_canonical_label", f"""
SELECT video_id, segment_id, {canonical_sql('deberta_label', "'?'")} AS label, {display_sql('deberta_label')} AS shown,
  {canonical_sql('deberta_label', "'neutral'")} AS timeline, ({canonical_sql('deberta_label', 'NULL')}) IS NOT NULL AS known
FROM predictions WHERE deberta_label IS NOT NULL""")
def _(t):
    raw = F.col("deberta_label")
    tl = L.timeline_label(raw)
    return t.predictions.where(raw.isNotNull()).select(
        "video_id", "segment_id", L.canonicalize(raw, F.lit("?")).alias("label"), L.display(raw).alias("shown"),
        tl["label"].alias("timeline"), tl["is_known"].alias("known"))
