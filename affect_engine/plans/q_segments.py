"""Shots, scenes, words, sentences, segments, transcripts."""

from pyspark.sql import functions as F

from ..functions.sentences import CAPITAL
from ..operators import scenes as S
from ..operators import segments as G
from ..operators import transcripts as T
from ..session import materialize
from .catalog import query
from .derived import SQL_VIEWS
from .q_text import W_CHAR, overlap_sql, rx, words_sql


def scene_sql(source: str, limit: float, gap: float) -> str:
    return f"""
SELECT video_id, dense_rank() OVER (PARTITION BY video_id ORDER BY scene_start) - 1 AS global_scene_id,
  min(start) AS start, max_by("end", scene_id) AS "end", max_by("end", scene_id) - min(start) AS duration,
  count(*) AS shot_count, min(scene_id) AS first_shot, max(scene_id) AS last_shot
FROM {source} GROUP BY video_id, scene_start"""


def fold_sql(shots: str, limit: float, gap: float) -> str:
    return f"""
SELECT video_id, scene_id, start, "end", start AS s0, scene_id AS scene_start FROM {shots} WHERE scene_id = 0
UNION ALL
SELECT n.video_id, n.scene_id, n.start, n."end",
  CASE WHEN n."end" - f.s0 > {limit} OR n.start - f."end" > {gap} THEN n.start ELSE f.s0 END,
  CASE WHEN n."end" - f.s0 > {limit} OR n.start - f."end" > {gap} THEN n.scene_id ELSE f.scene_start END
FROM %s f JOIN {shots} n ON n.video_id = f.video_id AND n.scene_id = f.scene_id + 1"""


W10_SQL = f"""WITH RECURSIVE fold AS ({fold_sql('shots', 900.0, 5.0) % 'fold'}) {scene_sql('fold', 900, 5)}"""


@query("w10_global_scenes", f"""
SELECT video_id, global_scene_id, round(start, 6) AS start, round("end", 6) AS "end", round(duration, 6) AS duration, shot_count, first_shot, last_shot
FROM ({W10_SQL})""".replace("(WITH", "(WITH"))
def _(t):
    out = S.global_scenes(t.shots)
    return out.select("video_id", "global_scene_id", *[F.round(c, 6).alias(c) for c in ("start", "end", "duration")],
                      "shot_count", "first_shot", "last_shot")


SQL_VIEWS["uneven_shots"] = """
SELECT video_id, scene_id, start, start + ((scene_id * 37 + video_id) % 97) * 11 AS "end" FROM shots"""


@query("w10_scenes_of_uneven_shots", f"""
WITH RECURSIVE uneven_fold AS ({fold_sql('uneven_shots', 900.0, 5.0) % 'uneven_fold'})
SELECT video_id, global_scene_id, round(start, 6) AS start, round("end", 6) AS "end", shot_count, first_shot, last_shot
FROM ({scene_sql('uneven_fold', 900, 5)})""")
def _(t):
    """Shots whose ends don't follow the order of their starts."""
    late = F.col("start") + (F.col("scene_id") * 37 + F.col("video_id")) % 97 * 11
    out = S.global_scenes(t.shots.withColumn("end", late))
    return out.select("video_id", "global_scene_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"),
                      "shot_count", "first_shot", "last_shot")


SQL_VIEWS["talk_shots"] = """SELECT video_id, segment_id AS scene_id, start, "end", duration FROM segments"""
SQL_VIEWS["talk_scenes"] = f"""WITH RECURSIVE talk_fold AS ({fold_sql('talk_shots', 60.0, 5.0) % 'talk_fold'}) {scene_sql('talk_fold', 60, 5)}"""


def talk_scenes(t):
    shots = t.segments.select("video_id", F.col("segment_id").alias("scene_id"), "start", "end")
    return S.global_scenes(shots, max_duration=60.0)


@query("w10_scenes_of_recordings", """
SELECT video_id, global_scene_id, start, "end", shot_count FROM talk_scenes""")
def _(t):
    return talk_scenes(t).select("video_id", "global_scene_id", "start", "end", "shot_count")


J1_SQL = """
SELECT w.video_id, w.segment_id, w.i, s.global_scene_id FROM words w
LEFT JOIN talk_scenes s ON s.video_id = w.video_id AND s.start <= w.start AND w.start < s."end" """


@query("j1_words_to_scenes", J1_SQL)
def _(t):
    return S.words_to_scenes(t.words, talk_scenes(t)).select("video_id", "segment_id", "i", "global_scene_id")


@query("j1_words_to_scenes_by_range", f"SELECT * FROM ({J1_SQL}) WHERE global_scene_id IS NOT NULL")
def _(t):
    return S.words_to_scenes_by_range(t.words, talk_scenes(t), 60.0).select("video_id", "segment_id", "i", "global_scene_id")


def placed_words(t, scenes=None):
    return materialize(S.words_to_scenes(t.words, talk_scenes(t) if scenes is None else scenes), "placed-words")


SQL_VIEWS["seg_words"] = """
SELECT w.video_id, s.global_scene_id, w.word, w.start, w."end", w.probability,
  row_number() OVER (PARTITION BY w.video_id, s.global_scene_id ORDER BY w.segment_id, w.i) - 1 AS w
FROM words w JOIN talk_scenes s ON s.video_id = w.video_id AND s.start <= w.start AND w.start < s."end" """
_spaced = rx("word", rf"([.!?…])({CAPITAL})", r"\1 \2")
_dots = rx(f"replace({_spaced}, '…', '...')", r"\.{3,}", "...")
SQL_VIEWS["seg_tokens"] = f"""
SELECT video_id, global_scene_id, p, token,
  sum(CASE WHEN regexp_matches(before, '[.!?…]$') AND regexp_matches(token, '^{CAPITAL}') THEN 1 ELSE 0 END) OVER w AS sid,
  sum(CASE WHEN regexp_matches(before, '[,;—]$') THEN 1 ELSE 0 END) OVER w AS clause
FROM (SELECT *, row_number() OVER v - 1 AS p, lag(token) OVER v AS before
      FROM (SELECT video_id, global_scene_id, w, unnest(ts) AS token, unnest(range(len(ts))) AS k
            FROM (SELECT *, {words_sql(_dots)} AS ts FROM seg_words))
      WINDOW v AS (PARTITION BY video_id, global_scene_id ORDER BY w, k))
WINDOW w AS (PARTITION BY video_id, global_scene_id ORDER BY p)"""
SQL_VIEWS["seg_sizes"] = f"""
SELECT video_id, global_scene_id, sid, count(*) AS n, min(p) AS p0, min(clause) AS c0,
  count(*) >= 2 AND bool_or(regexp_matches(token, '{W_CHAR}')) AS good
FROM seg_tokens GROUP BY ALL"""
SQL_VIEWS["seg_counted"] = """
SELECT video_id, global_scene_id, sid, p, p - p0 AS pos, clause - c0 AS clause, token, n FROM seg_tokens JOIN seg_sizes USING (video_id, global_scene_id, sid) WHERE good
UNION ALL
SELECT video_id, global_scene_id, 0, p, p, clause, token, n FROM seg_tokens
JOIN (SELECT video_id, global_scene_id, sum(n) AS n FROM seg_sizes GROUP BY ALL HAVING NOT bool_or(good)) USING (video_id, global_scene_id)"""


def split_sql(limit: int) -> str:
    keys = "video_id, global_scene_id, sid"
    return f"""
WITH RECURSIVE clauses AS (
  SELECT {keys}, clause, min(pos) AS f, max(pos) + 1 AS t FROM seg_counted GROUP BY ALL
), packed AS (
  SELECT {keys}, clause, f AS base FROM clauses WHERE clause = 0
  UNION ALL
  SELECT c.video_id, c.global_scene_id, c.sid, c.clause, CASE WHEN c.t - k.base > {limit} THEN c.f ELSE k.base END
  FROM packed k JOIN clauses c ON c.video_id = k.video_id AND c.global_scene_id = k.global_scene_id AND c.sid = k.sid AND c.clause = k.clause + 1
)
SELECT {keys}, (base + (pos - base) // {limit} * {limit})::BIGINT AS part, min(p) AS p, count(*) AS n_tokens,
  string_agg(token, ' ' ORDER BY p) AS sentence
FROM seg_counted JOIN packed USING ({keys}, clause) GROUP BY ALL"""


SQL_VIEWS["seg_sentences"] = split_sql(30)
SQL_VIEWS["seg_timed"] = """
SELECT o.video_id, o.global_scene_id, s, sentence, n_tokens, arg_min(w.start, w.w) AS start, arg_max(w."end", w.w) AS "end",
  count(*) AS n_words, sum(probability) AS confidence_sum
FROM (SELECT *, row_number() OVER v - 1 AS s, sum(n_tokens) OVER v - n_tokens AS f FROM seg_sentences
      WINDOW v AS (PARTITION BY video_id, global_scene_id ORDER BY p)) o
JOIN seg_words w ON w.video_id = o.video_id AND w.global_scene_id = o.global_scene_id AND w.w >= f AND w.w < f + n_tokens
GROUP BY o.video_id, o.global_scene_id, s, sentence, n_tokens"""


def half_even(x: str, digits: int) -> str:
    """Rounding to the even digit, on the decimal value as it is written."""
    scaled = f"({x})::DECIMAL(18, 9) * {10 ** digits}"
    return f"""((floor({scaled}) + CASE WHEN {scaled} - floor({scaled}) > 0.5 OR ({scaled} - floor({scaled}) = 0.5 AND floor({scaled}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / {10 ** digits})"""


def segments_sql(name: str, alike: str) -> str:
    """Sentences packed one after another; ``alike`` compares a sentence ``b`` with the one before, ``a``."""
    return f"""
WITH RECURSIVE ordered AS (
  SELECT b.*, {alike} AS sim FROM {name} b
  LEFT JOIN {name} a ON a.video_id = b.video_id AND a.global_scene_id = b.global_scene_id AND a.s = b.s - 1
), fold AS (
  SELECT video_id, global_scene_id, s, s AS seg, n_tokens AS size, 1 AS k FROM ordered WHERE s = 0
  UNION ALL
  SELECT video_id, global_scene_id, s, CASE WHEN cut THEN s ELSE seg END, CASE WHEN cut THEN n ELSE size + n END, CASE WHEN cut THEN 1 ELSE k + 1 END
  FROM (SELECT o.video_id, o.global_scene_id, o.s, f.seg, f.size, f.k, o.n_tokens AS n,
               f.size + o.n_tokens > 30 OR f.k + 1 > 4 OR (f.size >= 15 AND o.sim < 0.35) AS cut
        FROM fold f JOIN ordered o ON o.video_id = f.video_id AND o.global_scene_id = f.global_scene_id AND o.s = f.s + 1)
), segs AS (
  SELECT o.video_id, o.global_scene_id, seg, min(o.start) AS s0, arg_max(o."end", o.s) AS e0, string_agg(sentence, ' ' ORDER BY o.s) AS text,
    count(*) AS sentence_count, sum(n_words) AS word_count, sum(n_tokens) AS tokens, sum(confidence_sum) / sum(n_words) AS mean
  FROM ordered o JOIN fold USING (video_id, global_scene_id, s) GROUP BY ALL
), seen AS (
  SELECT *, lag(seg) OVER w IS NOT NULL AND lead(seg) OVER w IS NULL AND tokens < 6 AS tail,
    lead(text) OVER w AS text2, lead(e0) OVER w AS e2, lead(tokens) OVER w AS tokens2, lead(sentence_count) OVER w AS count2
  FROM segs WINDOW w AS (PARTITION BY video_id, global_scene_id ORDER BY seg)
), spoken AS (
  SELECT *, coalesce(lead(tail) OVER (PARTITION BY video_id, global_scene_id ORDER BY seg), false) AS takes FROM seen
)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY global_scene_id, seg) - 1 AS local_segment_id, * EXCLUDE (video_id, seg) FROM (
  SELECT video_id, global_scene_id, seg, {half_even('s0', 2)} AS start, CASE WHEN takes THEN e2 ELSE {half_even('e0', 2)} END AS "end",
    CASE WHEN takes THEN text || ' ' || text2 ELSE text END AS text,
    sentence_count + CASE WHEN takes THEN count2 ELSE 0 END AS sentence_count, (word_count + CASE WHEN takes THEN tokens2 ELSE 0 END)::BIGINT AS word_count,
    true AS has_speech, CASE WHEN mean <> 0 THEN {half_even('mean', 3)} END AS confidence
  FROM spoken WHERE NOT tail
  UNION ALL
  SELECT s.video_id, s.global_scene_id, 0, s.start, s."end", CASE WHEN n > 0 THEN repeat(' ', (n - 1)::INT) ELSE '' END, 0, coalesce(n, 0), n IS NOT NULL, mean
  FROM talk_scenes s LEFT JOIN (SELECT video_id, global_scene_id, count(*) AS n, avg(probability) AS mean FROM seg_words GROUP BY ALL) USING (video_id, global_scene_id)
  WHERE (s.video_id, s.global_scene_id) NOT IN (SELECT (video_id, global_scene_id) FROM segs))"""


_LETTERS = "[" + ", ".join(f"(length(lower(sentence)) - length(replace(lower(sentence), '{c}', '')))::DOUBLE" for c in "aeinorst") + "]"
SQL_VIEWS["seg_bags"] = f"""
SELECT *, {overlap_sql('sentence')} AS bag, CASE WHEN n_tokens > 3 THEN {_LETTERS} END AS vec FROM seg_timed"""
_WORDS = """CASE WHEN a.s IS NULL OR len(a.bag) = 0 OR len(b.bag) = 0 THEN 0.0 ELSE
  len(list_intersect(a.bag, b.bag))::DOUBLE / (len(a.bag) + len(b.bag) - len(list_intersect(a.bag, b.bag))) END"""
_dot = "list_sum(list_transform(list_zip({0}.vec, {1}.vec), lambda p : p[1] * p[2]))"
_length = f"(sqrt({_dot.format('a', 'a')}) * sqrt({_dot.format('b', 'b')}))"
_VECTORS = f"coalesce(greatest(0.0, {_dot.format('a', 'b')} / nullif({_length}, 0)), {_WORDS})"

SEGMENT_COLUMNS = """video_id, local_segment_id, global_scene_id, round(start, 2) AS start, round("end", 2) AS "end", text, sentence_count, word_count, has_speech,
  round(confidence, 3) AS confidence_average"""


def segment_columns(out):
    return out.select(
        "video_id", "local_segment_id", "global_scene_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "text",
        "sentence_count", "word_count", "has_speech", F.round("confidence_average", 3).alias("confidence_average"))


@query("w11_local_segments", f"""
SELECT {SEGMENT_COLUMNS} FROM ({segments_sql('seg_bags', _WORDS)})""")
def _(t):
    scenes = materialize(talk_scenes(t).select("video_id", "global_scene_id", "start", "end"), "scenes")
    return segment_columns(G.local_segments(placed_words(t, scenes), scenes))


@query("w11_local_segments_by_vectors", f"""
SELECT {SEGMENT_COLUMNS} FROM ({segments_sql('seg_bags', _VECTORS)})""")
def _(t):
    """A stand-in model: how often a sentence has each of eight letters; none for short ones."""
    def embed(sentences):
        low = F.lower("sentence")
        counts = [F.regexp_count(low, F.lit(c)).cast("double") for c in "aeinorst"]
        return sentences.withColumn("vector", F.when(F.col("n_tokens") > 3, F.array(*counts)))

    scenes = materialize(talk_scenes(t).select("video_id", "global_scene_id", "start", "end"), "scenes")
    return segment_columns(G.local_segments(placed_words(t, scenes), scenes, embed=embed))


@query("w12_timed_sentences", """
SELECT video_id, global_scene_id, s, sentence, n_tokens, start, "end", n_words, round(confidence_sum, 6) AS confidence_sum FROM seg_timed""")
def _(t):
    numbered = materialize(G.number_words(placed_words(t)), "scene-words")
    return G.timed_sentences(numbered, 30).withColumn("confidence_sum", F.round("confidence_sum", 6))


@query("t13_split_long_sentences", split_sql(12))
def _(t):
    numbered = materialize(G.number_words(placed_words(t)), "scene-words")
    return G.split_sentences(materialize(G.sentence_tokens(numbered), "sentence-tokens"), 12)


@query("w13_sequential_ids", """
SELECT video_id, segment_id, i, row_number() OVER (PARTITION BY video_id ORDER BY segment_id, i) - 1 AS ordinal FROM words""")
def _(t):
    return G.sequential_ids(t.words.select("video_id", "segment_id", "i"))


@query("w2_shot_problems", """
SELECT video_id, scene_id, unnest(list_filter([
  CASE WHEN scene_id = 0 AND abs(start) > 0.01 THEN 'late_start' END,
  CASE WHEN abs(nxt - "end") > 0.1 THEN 'gap' END, CASE WHEN "end" > nxt THEN 'overlap' END,
  CASE WHEN nxt IS NOT NULL AND abs("end" - start - duration) > 0.01 THEN 'duration_mismatch' END,
  CASE WHEN nxt IS NULL AND abs("end" - 2580.0) > 1.0 THEN 'end_mismatch' END], lambda x : x IS NOT NULL)) AS problem
FROM (SELECT video_id, scene_id, start + (video_id % 5 = 0)::INT AS start, "end", duration,
  lead(start + (video_id % 5 = 0)::INT) OVER (PARTITION BY video_id ORDER BY scene_id) AS nxt FROM shots)""")
def _(t):
    late = t.shots.withColumn("start", F.col("start") + (F.col("video_id") % 5 == 0).cast("int"))
    durations = t.events.select(F.col("user_id").alias("video_id")).distinct().withColumn("video_duration", F.lit(2580.0))
    return S.shot_problems(late, durations)


@query("w4_scene_problems", f"""
SELECT video_id, global_scene_id, unnest(list_filter([CASE WHEN global_scene_id = 0 AND start > 5 THEN 'late_start' END,
  CASE WHEN abs(nxt - "end") > 1.0 THEN 'gap' END, CASE WHEN "end" > nxt THEN 'overlap' END,
  CASE WHEN nxt IS NOT NULL AND abs("end" - start - duration) > 0.1 THEN 'duration_mismatch' END], lambda x : x IS NOT NULL)) AS problem
FROM (SELECT *, lead(start) OVER (PARTITION BY video_id ORDER BY global_scene_id) AS nxt FROM ({W10_SQL}))""")
def _(t):
    return S.scene_problems(S.global_scenes(t.shots))


SQL_VIEWS["counted"] = """
SELECT *, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w : w <> '')) AS word_count,
  1 + length(text) % 7 AS sentence_count FROM segments"""


def counted(t):
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).cast("long")
    return t.segments.withColumn("word_count", n).withColumn("sentence_count", 1 + F.length("text") % 7)


@query("w5_segment_problems", """
SELECT video_id, segment_id, unnest(list_filter([CASE WHEN has_speech AND word_count < 8 THEN 'too_short' END,
  CASE WHEN word_count > 60 THEN 'too_long' END, CASE WHEN has_speech AND word_count = 0 THEN 'speech_without_words' END,
  CASE WHEN has_speech AND text = '' THEN 'speech_without_text' END, CASE WHEN abs("end" - start - duration) > 0.1 THEN 'duration_mismatch' END,
  CASE WHEN nxt - "end" > 5 THEN 'gap' END], lambda x : x IS NOT NULL)) AS problem
FROM (SELECT * EXCLUDE (start), start + (segment_id % 4) * 3 AS start, lead(start + (segment_id % 4) * 3) OVER (PARTITION BY video_id ORDER BY segment_id) AS nxt FROM counted)""")
def _(t):
    return S.segment_problems(counted(t).withColumn("start", F.col("start") + F.col("segment_id") % 4 * 3))


@query("a6_segment_statistics", """
SELECT video_id, count(*) AS total_segments, count(*) FILTER (has_speech) AS segments_with_speech, sum(word_count)::BIGINT AS total_words,
  count(*) FILTER (has_speech AND word_count < 8) AS words_under_8, count(*) FILTER (has_speech AND word_count >= 8 AND word_count < 25) AS words_8_25,
  count(*) FILTER (has_speech AND word_count >= 25 AND word_count < 40) AS words_25_40, count(*) FILTER (has_speech AND word_count BETWEEN 40 AND 60) AS words_40_60,
  count(*) FILTER (has_speech AND word_count > 60) AS words_over_60, """
    + ", ".join(f"count(*) FILTER (has_speech AND sentence_count = {k}) AS sentences_{k}" for k in range(1, 6)) + """,
  count(*) FILTER (has_speech AND sentence_count > 5) AS sentences_over_5, round(avg(word_count) FILTER (has_speech), 6) AS average_words,
  round(avg(sentence_count) FILTER (has_speech), 6) AS average_sentences, quantile_cont(word_count, 0.5) FILTER (has_speech) AS median_words
FROM counted GROUP BY video_id""")
def _(t):
    out = G.segment_statistics(counted(t))
    return out.withColumn("average_words", F.round("average_words", 6)).withColumn("average_sentences", F.round("average_sentences", 6))


@query("a7_shot_statistics", """
SELECT video_id, count(*) AS n, round(avg(duration), 9) AS average, round(min(duration), 9) AS shortest, round(max(duration), 9) AS longest,
  round(sum(duration), 9) AS total, round(quantile_cont(duration, 0.5), 9) AS median FROM shots GROUP BY video_id""")
def _(t):
    out = S.duration_statistics(t.shots, ["video_id"])
    return out.select("video_id", "n", *[F.round(c, 9).alias(c) for c in ("average", "shortest", "longest", "total", "median")])


@query("a7_reduction_ratio", f"""
SELECT a.video_id, shots, scenes, round(shots / scenes, 6) AS reduction FROM (SELECT video_id, count(*) AS shots FROM shots GROUP BY video_id) a
JOIN (SELECT video_id, count(*) AS scenes FROM ({W10_SQL}) GROUP BY video_id) b USING (video_id)""")
def _(t):
    return S.reduction_ratio(t.shots, S.global_scenes(t.shots)).withColumn("reduction", F.round("reduction", 6))


SQL_VIEWS["transcript"] = """
SELECT video_id, segment_id, CASE WHEN segment_id % 9 = 7 THEN start - 45 ELSE start END AS start, CASE WHEN segment_id % 11 = 5 THEN NULL ELSE "end" END AS "end",
  text, ((video_id*13 + segment_id*7) % 100)/100.0::DOUBLE AS no_speech_prob,
  -((video_id*17 + segment_id*5) % 100)/100.0::DOUBLE AS avg_logprob,
  ((video_id*19 + segment_id*3) % 100)/30.0::DOUBLE AS compression_ratio,
  CASE WHEN (video_id + segment_id) % 10 = 0 THEN 0 ELSE length(text) END AS n_words FROM segments"""


def transcript(t):
    v, s = F.col("video_id"), F.col("segment_id")
    return t.segments.select(
        v, s, F.when(s % 9 == 7, F.col("start") - 45).otherwise(F.col("start")).alias("start"),
        F.when(s % 11 != 5, F.col("end")).alias("end"), "text",
        ((v * 13 + s * 7) % 100 / 100.0).alias("no_speech_prob"), (-((v * 17 + s * 5) % 100) / 100.0).alias("avg_logprob"),
        ((v * 19 + s * 3) % 100 / 30.0).alias("compression_ratio"),
        F.when((v + s) % 10 == 0, 0).otherwise(F.length("text")).alias("n_words"))


@query("f6_transcript_flags", """
SELECT video_id, segment_id, concat_ws(',', CASE WHEN no_speech_prob > 0.6 THEN 'likely_silence' END, CASE WHEN avg_logprob < -0.5 THEN 'low_confidence' END,
  CASE WHEN compression_ratio > 2.4 THEN 'possible_repetition' END, CASE WHEN n_words = 0 THEN 'no_word_timestamps' END) AS flags FROM transcript""")
def _(t):
    flags = T.quality_flags(F.col("no_speech_prob"), F.col("avg_logprob"), F.col("compression_ratio"), F.col("n_words"))
    return transcript(t).select("video_id", "segment_id", F.array_join(flags, ",").alias("flags"))


@query("a8_transcript_statistics", """
SELECT * FROM (SELECT video_id, count(*) AS total_segments, count(*) FILTER (avg_logprob < -0.5) AS low_confidence_segments,
  count(*) FILTER (compression_ratio > 2.4) AS high_compression_segments, count(*) FILTER (no_speech_prob > 0.6) AS high_no_speech_segments FROM transcript GROUP BY video_id)
JOIN (SELECT video_id, count(*) AS total_words, round(avg(probability), 6) AS average_confidence FROM words GROUP BY video_id) USING (video_id)""")
def _(t):
    return T.transcript_statistics(transcript(t), t.words).withColumn("average_confidence", F.round("average_confidence", 6))


@query("w6_transcript_problems", """
SELECT video_id, segment_id, unnest(list_filter([CASE WHEN "end" IS NULL THEN 'missing_end' END, CASE WHEN start < 0 THEN 'negative_start' END,
  CASE WHEN coalesce("end", 0) < start THEN 'reversed' END, CASE WHEN start < prev - 0.1 THEN 'overlaps_previous' END], lambda x : x IS NOT NULL)) AS problem
FROM (SELECT *, lag(coalesce("end", 0)) OVER (PARTITION BY video_id ORDER BY segment_id) AS prev FROM transcript)""")
def _(t):
    return T.transcript_problems(transcript(t))


@query("w6_word_problems", """
SELECT video_id, segment_id, i, unnest(list_filter([CASE WHEN w.start < f - 0.1 OR w."end" > e + 0.1 THEN 'outside_segment' END,
  CASE WHEN w.start < prev - 0.01 THEN 'overlaps_previous' END], lambda x : x IS NOT NULL)) AS problem
FROM (SELECT video_id, segment_id, i, start, "end" + (i % 7 = 3)::INT AS "end", lag("end" + (i % 7 = 3)::INT) OVER (PARTITION BY video_id, segment_id ORDER BY i) AS prev FROM words) w
JOIN (SELECT video_id, segment_id, start AS f, "end" AS e FROM segments) USING (video_id, segment_id)""")
def _(t):
    late = t.words.withColumn("end", F.col("end") + (F.col("i") % 7 == 3).cast("int"))
    return T.word_problems(late, t.segments)


SQL_VIEWS["transcriptions"] = """
SELECT o_custkey AS video_id, 'transcription_' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE '600' END AS duration_limit,
  strftime(o_orderdate, '%Y-%m') AS transcription_date, ['large-v3','medium','base','tiny','other'][o_orderkey % 5 + 1] AS model,
  (o_orderkey % 100)::DOUBLE AS duration FROM orders"""


def transcriptions(t):
    k = F.col("o_orderkey")
    models = F.array(*[F.lit(m) for m in ("large-v3", "medium", "base", "tiny", "other")])
    return t.orders.select(
        F.col("o_custkey").alias("video_id"), F.concat(F.lit("transcription_"), k).alias("path"),
        F.when(k % 3 == 0, "full").otherwise("600").alias("duration_limit"), F.date_format("o_orderdate", "yyyy-MM").alias("transcription_date"),
        F.element_at(models, (k % 5 + 1).cast("int")).alias("model"), (k % 100).cast("double").alias("duration"))


@query("w7_best_transcription", """
SELECT video_id, path, duration_limit, transcription_date, model, duration FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY duration_limit = 'full' DESC, transcription_date DESC,
  CASE model WHEN 'large-v3' THEN 5 WHEN 'medium' THEN 3 WHEN 'base' THEN 1 ELSE 0 END DESC, duration DESC, path DESC) AS rn FROM transcriptions) WHERE rn = 1""")
def _(t):
    return T.best_transcription(transcriptions(t))


@query("io3_preferred_model", """
SELECT video_id, model, n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY model <> 'medium', model) AS rn
FROM (SELECT video_id, model, count(*) AS n FROM transcriptions GROUP BY ALL)) WHERE rn = 1""")
def _(t):
    per = transcriptions(t).groupBy("video_id", "model").agg(F.count("*").alias("n"))
    return T.preferred_model(per, "video_id", "model", "medium")


@query("f7_download_rules", """
SELECT o_orderkey, concat_ws(',', CASE WHEN v < 0.1 THEN 'video_too_small' END, CASE WHEN a < 0.1 THEN 'audio_too_small' END,
  CASE WHEN d > 0 AND v + a < d/60*15/10 THEN 'truncated' END) AS issues
FROM (SELECT o_orderkey, (o_orderkey % 200)/100.0::DOUBLE AS v, (o_orderkey % 70)/100.0::DOUBLE AS a, (o_orderkey % 90)::DOUBLE AS d FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    issues = T.download_issues(k % 200 / 100.0, k % 70 / 100.0, (k % 90).cast("double"))
    return t.orders.select("o_orderkey", F.array_join(issues, ",").alias("issues"))
