"""The normaliser step by step, sentences, similarity, scalar functions."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scalar, sentences, text, vocab
from ..operators import ensemble
from ..operators.cleaning import clean_texts
from .catalog import query
from .derived import SQL_VIEWS

WS = text.SPACE
NOT_WS = "[^" + WS[1:]
W_CHAR = r"[\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(WS + '+')}), lambda w : w <> '')"


def rx(x: str, pattern: str, new: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, {q(flags)})"


def join_words(x: str, body: str) -> str:
    return f"array_to_string(list_transform({words_sql(x)}, lambda w : {body}), ' ')"


PH = "(starts_with(w, '[') AND ends_with(w, ']'))"


def sql_quotes(x):
    return f"translate({x}, {q(''.join(vocab.QUOTES))}, {q(''.join(vocab.QUOTES.values()))})"


def sql_placeholders(x):
    for name, spellings in vocab.PLACEHOLDERS.items():
        x = rx(x, rf"\[(?:{'|'.join(spellings)})\]", f"[{name}]", "gi")
    return x


def sql_emoji(x):
    return rx(rx(x, text.EMOJI, ""), text.EMOTICONS, "")


SLANG_SQL = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in vocab.SLANG.items()) + "}"


def sql_slang(x):
    return join_words(x, f"coalesce({SLANG_SQL}[trim(lower(w), {q(text.WORD_EDGE)})], w)")


def sql_mask(x):
    x = rx(x, rf"https?://{NOT_WS}+|www\.{NOT_WS}+", "[URL]")
    x = rx(rx(x, rf"@{W_CHAR}+", "[TAG]"), rf"#{W_CHAR}+", "[TAG]")
    x = rx(x, r"\b\d+\.?\d*\b", "[NUM]")
    x = rx(x, rf"\b(?:{'|'.join(vocab.NAMES)})\b", "[NAME]")
    x = rx(x, rf"\b(?:{'|'.join(vocab.RELIGIONS)})\b", "[RELIGION]", "gi")
    return rx(x, rf"\b(?:{'|'.join(vocab.CITIES)})\b", "[CITY]")


def sql_space(x):
    return f"trim({rx(x, WS + '+', ' ')}, ' ')"


def sql_shout(x):
    bare = f"trim(w, {q(text.WORD_EDGE)})"
    return join_words(
        x,
        f"CASE WHEN {PH} THEN w WHEN regexp_full_match({bare}, '\\p{{L}}{{2,}}') AND upper({bare}) = {bare} "
        f"AND lower({bare}) <> {bare} THEN '[CAPS] ' || lower(w) ELSE lower(w) END",
    )


def sql_punct(x):
    x = rx(rx(x, r"!{2,}", "!!"), r"\?{2,}", "??")
    pieces = f"regexp_extract_all({x}, '[?!]{{3,}}|[?!]{{1,2}}|[^?!]+')"
    settle = (
        "CASE WHEN regexp_full_match(w, '[?!]{3,}') THEN CASE WHEN length(replace(w, '?', '')) > "
        "length(replace(w, '!', '')) THEN '!!' ELSE '??' END ELSE w END"
    )
    x = f"array_to_string(list_transform({pieces}, lambda w : {settle}), '')"
    return rx(rx(rx(x, r"\.{4,}", "..."), r",{2,}", ","), WS + r"+([.,!?;:])", r"\1")


def sql_squeeze(x):
    chars = "string_split(w, '')"
    kept = (
        f"list_filter({chars}, lambda c, k : NOT (k > 2 AND c = substr(w, k - 1, 1) AND c = substr(w, k - 2, 1)))"
    )
    return join_words(x, f"CASE WHEN {PH} THEN w ELSE array_to_string({kept}, '') END")


def sql_drop(x):
    ws = words_sql(x)
    pairs = f"list_zip({ws}, list_concat([''], {ws}))"
    keep = "p[1] IS NOT NULL AND NOT (starts_with(p[1], '[') AND ends_with(p[1], ']') AND p[1] = p[2])"
    return f"array_to_string(list_transform(list_filter({pairs}, lambda p : {keep}), lambda p : p[1]), ' ')"


EARLY = [sql_quotes, sql_placeholders, sql_emoji, sql_slang, sql_mask, sql_space]
LATE = [sql_shout, sql_space, sql_punct, sql_squeeze]
TIDY = [sql_drop, sql_space]


def chain_sql(steps, source="documents", key="doc_id", column="text") -> str:
    sql = f"SELECT {key}, {column} AS text FROM {source}"
    for step in steps:
        sql = f"SELECT {key}, {step('text')} AS text FROM ({sql})"
    return sql


SQL_VIEWS["docs_early"] = chain_sql(EARLY)
SQL_VIEWS["docs_clean"] = chain_sql(EARLY + LATE + TIDY)

# Driver texts hold few of the marks the normaliser looks for, so a prefix and a
# suffix that depend on the row are put around each whole text.
MARKS = (
    "“Wow” OMG!!!!",
    "[name] and [Org] :-) lol",
    "http://a.b/c @you #tag 12.5 and 7",
    "GREAT NEWS?!?!! soooo good,,, ok....",
    "[TAG] [TAG] [tag] end ;) b4 u",
    "Joe met Hindu friends in New York – tbh",
    "John ,what?? REALLY!!?? noooo",
)
SQL_VIEWS["marked"] = (
    "SELECT doc_id, lang, source, [" + ", ".join(q(m) for m in MARKS)
    + "][doc_id % 7 + 1] || ' ' || text || ' ' || [" + ", ".join(q(m) for m in MARKS)
    + "][(doc_id + 3) % 7 + 1] AS text FROM documents"
)


def marked(t):
    marks = F.array(*[F.lit(m) for m in MARKS])
    return t.texts.select(
        "doc_id", "lang", "source",
        F.concat_ws(
            " ",
            F.element_at(marks, (F.col("doc_id") % 7 + 1).cast("int")),
            "text",
            F.element_at(marks, ((F.col("doc_id") + 3) % 7 + 1).cast("int")),
        ).alias("text"),
    )


for _name, _fn, _sql in (
    ("t1_normalize_quotes", text.normalize_quotes, sql_quotes),
    ("t2_normalize_placeholders", text.normalize_placeholders, sql_placeholders),
    ("t3_strip_emoji", text.strip_emoji, sql_emoji),
    ("t4_expand_slang", text.expand_slang, sql_slang),
    ("t5_mask_entities", text.mask_entities, sql_mask),
    ("t6_collapse_whitespace", text.collapse_whitespace, sql_space),
    ("t7_mark_shouting", text.mark_shouting, sql_shout),
    ("t8_normalize_punctuation", text.normalize_punctuation, sql_punct),
    ("t9_squeeze_repeats", text.squeeze_repeats, sql_squeeze),
    ("t10_drop_repeated_placeholders", text.drop_repeated_placeholders, sql_drop),
):
    query(_name, chain_sql([_sql], "marked"))(
        lambda t, fn=_fn: marked(t).select("doc_id", fn(F.col("text")).alias("text"))
    )

SQL_VIEWS["marked_early"] = chain_sql(EARLY, "marked")
SQL_VIEWS["marked_clean"] = chain_sql(EARLY + LATE + TIDY, "marked")


@query("t11_clean_early", "SELECT * FROM marked_early")
def _(t):
    return clean_texts(marked(t).select("doc_id", "text"), "text", text.transform_for("clean_early"))


@query("t11_clean_text", "SELECT * FROM marked_clean")
def _(t):
    return clean_texts(marked(t).select("doc_id", "text"), "text", text.transform_for("clean_text"))


def sentences_sql(x):
    x = sql_space(x)
    x = rx(x, rf"([.!?…])({sentences.CAPITAL})", r"\1 \2")
    x = rx(f"replace({x}, '…', '...')", r"\.{3,}", "...")
    x = rx(x, rf"([.!?…]){WS}+({sentences.CAPITAL})", "\\1\x01\\2")
    return (
        f"list_filter(string_split({x}, '\x01'), lambda s : "
        f"len({words_sql('s')}) >= 2 AND regexp_matches(s, '{W_CHAR}'))"
    )


@query("t12_split_sentences", f"""
SELECT doc_id, unnest({sentences_sql('text')}) AS sentence FROM documents""")
def _(t):
    return t.texts.select("doc_id", F.explode(sentences.split_sentences(F.col("text"))).alias("sentence"))


def overlap_sql(x):
    bare = f"list_transform({words_sql(f'lower({x})')}, lambda v : {rx('v', '[^' + W_CHAR[1:], '')})"
    stop = "[" + ", ".join(q(w) for w in vocab.OVERLAP_STOPWORDS) + "]"
    return f"list_distinct(list_filter({bare}, lambda v : length(v) >= 3 AND NOT list_contains({stop}, v)))"


@query("t14_word_overlap", f"""
SELECT pair_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE
  round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS similarity
FROM (SELECT pair_id, {overlap_sql('en')} AS a, {overlap_sql('ru')} AS b FROM pairs)""")
def _(t):
    return t.pairs.select("pair_id", F.round(sentences.word_overlap(F.col("en"), F.col("ru")), 6).alias("similarity"))


@query("t15_cosine", """
SELECT a.vec_id, round(greatest(0.0, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p : p[1]::DOUBLE * p[2]::DOUBLE))
  / sqrt(list_sum(list_transform(a.embedding, lambda x : x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x : x::DOUBLE * x::DOUBLE)))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    e = t.embeddings
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(
        "vec_id", F.round(sentences.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("t17_timeline_label_share", """
SELECT known, count(*) AS n FROM tl_long GROUP BY known""")
def _(t):
    p = ensemble.align_to_reference(t.predictions, ["video_id"])
    long = p.select(F.explode(F.filter(F.array("distil_label", "deberta_label", "ru_label"), lambda x: x.isNotNull())).alias("raw"))
    return long.groupBy(L.timeline_label(F.col("raw"))["is_known"].alias("known")).agg(F.count("*").alias("n"))


@query("t18_display_name", """
SELECT row_id, CASE WHEN label = 'joy' THEN 'Happiness' ELSE upper(label[1]) || label[2:] END AS shown FROM corpus""")
def _(t):
    return t.corpus.select("row_id", L.display(F.upper("label")).alias("shown"))


@query("t19_parse_annotations", """
SELECT row_id, unnest(regexp_extract_all(labels_source, '''([^'']*)''', 1)) AS annotation FROM corpus""")
def _(t):
    return t.corpus.select("row_id", F.explode(L.parse_annotations(F.col("labels_source"))).alias("annotation"))


SQL_VIEWS["urls"] = """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://youtu.be/' || lpad(page_id::VARCHAR, 11, '0')
  WHEN page_id % 4 = 2 THEN 'https://www.youtube.com/watch?list=a&v=' || lpad(page_id::VARCHAR, 11, '0') ELSE url END AS url FROM pages"""


def urls(t):
    padded = F.lpad(F.col("page_id").cast("string"), 11, "0")
    return t.pages.select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://youtu.be/"), padded))
                          .when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://www.youtube.com/watch?list=a&v="), padded))
                          .otherwise(F.col("url")).alias("url"))


@query("t20_video_id", f"""
SELECT page_id, coalesce(nullif(regexp_extract(url, {q(scalar.VIDEO_ID_PATTERNS[0])}, 1), ''),
  nullif(regexp_extract(url, {q(scalar.VIDEO_ID_PATTERNS[1])}, 1), '')) AS video_id FROM urls""")
def _(t):
    return urls(t).select("page_id", scalar.video_id(F.col("url")).alias("video_id"))


def baseline_sql(x):
    x = sql_space(f"lower({x})")
    x = rx(x, r"[^\p{L}\p{N}_\s!?.]", " ")
    return f"trim({rx(rx(x, '!{2,}', '!!'), chr(92) + '?{2,}', '??')}, ' ')"


@query("t21_baseline_clean", f"SELECT doc_id, {baseline_sql('text')} AS text FROM marked")
def _(t):
    return marked(t).select("doc_id", text.clean_baseline(F.col("text")).alias("text"))


def lemma_sql(x):
    x = rx(x, r"[^\p{L}\p{N}_\s\-]", " ")
    return f"lower({sql_space(rx(x, chr(92) + 'd+', ''))})"


@query("t21_lemma_clean", f"SELECT doc_id, {lemma_sql('text')} AS text FROM marked")
def _(t):
    return marked(t).select("doc_id", text.clean_for_lemmas(F.col("text")).alias("text"))


def tokens_sql(x):
    x = f"lower({x})"
    for p, new in (("!{2,}", " EXCLAMATION_MULTIPLE "), (r"\?{2,}", " QUESTION_MULTIPLE "), ("!", " EXCLAMATION "), (r"\?", " QUESTION ")):
        x = rx(x, p, new)
    return f"regexp_extract_all({x}, '{W_CHAR}+')"


@query("t22_emotion_tokens", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM marked")
def _(t):
    return marked(t).select("doc_id", F.array_join(text.emotion_tokens(F.col("text")), " ").alias("tokens"))


@query("t24_counters", f"""
SELECT doc_id, length(text) AS n_chars, len({words_sql('text')}) AS n_words, len(regexp_extract_all(text, '!')) AS n_exclamation,
  len(regexp_extract_all(text, '\\?')) AS n_question, round(len(regexp_extract_all(text, '[A-Z]'))::DOUBLE / length(text), 6) AS capital_ratio
FROM marked""")
def _(t):
    c = text.text_counters(F.col("text"))
    c["capital_ratio"] = F.round(c["capital_ratio"], 6)
    return marked(t).select("doc_id", *[v.alias(k) for k, v in c.items()])


@query("t25_softmax", """
SELECT vec_id, round(exp(e[1]::DOUBLE - m) / z, 6) AS p_first, round(1 / (1 + exp(-e[1]::DOUBLE)), 6) AS sigmoid_first, list_position(e, m) - 1 AS best
FROM (SELECT vec_id, embedding AS e, list_max(embedding) AS m,
  list_sum(list_transform(embedding, lambda x : exp(x::DOUBLE - list_max(embedding)::DOUBLE))) AS z FROM embeddings)""")
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.round(scalar.softmax(v)[0], 6).alias("p_first"),
                               F.round(scalar.sigmoid(v[0]), 6).alias("sigmoid_first"), scalar.argmax(v).alias("best"))


@query("t26_scale_annotation", """
SELECT event_id, round(least(greatest((value - 1.0) / 8.0, 0.0), 1.0), 6) AS scaled FROM events""")
def _(t):
    return t.events.select("event_id", F.round(scalar.scale_to_unit(F.col("value"), 1, 9), 6).alias("scaled"))


@query("t27_label_ids", """
SELECT row_id, list_position(['anger','disgust','fear','joy','neutral','sadness','surprise'], label) - 1 AS id FROM corpus""")
def _(t):
    return t.corpus.select("row_id", L.label_id(F.initcap("label")).alias("id"))


@query("t28_fixed_length", """
SELECT doc_id, array_to_string(list_transform(range(1, 13), lambda i : coalesce(length(w[i]), 0)), ',') AS ids
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def _(t):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return t.documents.select("doc_id", F.array_join(F.transform(text.fixed_length(ids, 12), lambda i: i.cast("string")), ",").alias("ids"))


@query("f16_safe_cast", """
SELECT event_id, try_cast(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN value::VARCHAR ELSE event_type END, '') AS DOUBLE) AS v FROM events""")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise(F.col("event_type"))
    return t.events.select("event_id", scalar.safe_double(raw).alias("v"))


@query("j6_slang_lookup", f"""
SELECT key, count(*) AS n FROM (SELECT trim(lower(unnest({words_sql('text')})), {q(text.WORD_EDGE)}) AS key FROM marked)
WHERE {SLANG_SQL}[key] IS NOT NULL GROUP BY key""")
def _(t):
    spark = t.spark
    table = spark.createDataFrame(list(vocab.SLANG.items()), "key string, expansion string")
    keys = marked(t).select(F.explode(text.words(F.col("text"))).alias("w")).select(
        F.btrim(F.lower("w"), F.lit(text.WORD_EDGE)).alias("key"))
    # The dictionary is a fixed table of fewer than 200 rows.
    return keys.join(F.broadcast(table), "key").groupBy("key").agg(F.count("*").alias("n"))
