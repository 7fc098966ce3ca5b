"""Registered queries of this subpackage: ``opN_<name>`` over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, corpus_queries, fingerprint, html_text, line_dedup, mixing, ngram_join, suffix_queries, toxicity, vector_queries
from .registry import LLM_QUERIES, LLM_SQL, query, table

__all__ = ["LLM_QUERIES", "LLM_SQL", "corpus_queries", "query", "suffix_queries", "table", "vector_queries"]


def remainder(key: str, divisor: int):
    """CRC-32 of an id's decimal text, modulo ``divisor``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


ODD_CONVERSATION = "</s>[INST] ok [/INST]"


@query("op2_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_CONVERSATION).alias("text"),
    )
    return chat.read_back(chat.format_chats(turns.unionByName(odd)))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"


@query(
    "op4_ngram_join",
    f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
    sh AS (
      SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 4
        THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s
      FROM w
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    common AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
      SELECT x, y FROM common JOIN sizes i ON i.doc_id = x JOIN sizes j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)
    ), reach(x, y) AS (
      SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
    )
    SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
    FROM reach LEFT JOIN sizes ON doc_id = x GROUP BY x
    """,
)
def ngram_components(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link(table(spark, folder, "documents"))


@query("op5_html_text")
def html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op6_fingerprints")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_edited(table(spark, folder, "documents"))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, learned from the labelled rows outside the held-out fold."""
    learn = labels.filter(remainder("doc_id", 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score(docs, toxicity.fit(docs, learn))


@query("op7_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxic_scores(docs, table(spark, folder, "labels")).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query(
    "op9_line_dedup",
    f"""
    WITH base AS (
      SELECT doc_id, coalesce(source, chr(0) || 'null') AS site, text, string_split(text, chr(10)) AS xs
      FROM documents WHERE text <> ''
    ), lines AS (
      SELECT doc_id, site, text, unnest(xs) AS line, unnest(range(len(xs))) AS pos,
             list_sort(list_distinct(list_transform(xs, lambda x: {{'n': length(x), 'x': x}})), 'DESC') AS top
      FROM base
    ), found AS (
      SELECT doc_id, site, text, line, pos,
             CASE WHEN top[1].x = line THEN CASE WHEN len(top) > 1 THEN top[2].x END ELSE top[1].x END AS ctx
      FROM lines WHERE trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) <> ''
    ), per_text AS (
      SELECT line, ctx, text, min({{'d': doc_id, 's': site}}) AS one FROM found GROUP BY ALL
    ), per_context AS (
      SELECT line, ctx, min(one) AS one, count(*) AS docs FROM per_text GROUP BY ALL
    ), bad AS (
      SELECT line FROM per_context GROUP BY line
      HAVING count(DISTINCT one.s) >= {line_dedup.MIN_SITES} AND count(*) >= {line_dedup.MIN_CONTEXTS} * sum(docs)
    ), kept AS (
      SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
      FROM (SELECT doc_id, unnest(xs) AS line, unnest(range(len(xs))) AS pos FROM base)
      WHERE line NOT IN (SELECT line FROM bad) GROUP BY doc_id
    )
    SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN d.text ELSE coalesce(k.text, '') END AS text,
           d.lang, d.source, d.n_chars,
           CAST(CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS INT)
             AS lines_removed
    FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
)
def line_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, folder, "documents"))


MIX_SEED = 11


@query(
    "op10_source_mix",
    f"""
    WITH RECURSIVE sizes AS (
      SELECT source, count(*) AS n FROM documents GROUP BY source
    ), rates AS (
      SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT count(*) FROM documents)::DOUBLE / n::DOUBLE AS rate
      FROM sizes
    ), steps(source, rate, k, term, total) AS (
      SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
      UNION ALL
      SELECT source, rate, k + 1, term * rate / (k + 1)::DOUBLE, total + term * rate / (k + 1)::DOUBLE FROM steps
      WHERE k < rate + 12 * sqrt(rate) + 20
    ), drawn AS (
      SELECT d.*, ('0x' || substr(md5(d.doc_id || ':{MIX_SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM documents d
    ), counted AS (
      SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
             any_value(d.n_chars) AS n_chars, count(*) AS copies
      FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND d.u >= s.total GROUP BY d.doc_id
    ), copied AS (
      SELECT doc_id, text, lang, source, n_chars, unnest(range(copies))::INT AS copy_no FROM counted
    )
    SELECT *, ('0x' || substr(md5(doc_id || ':' || copy_no || ':{MIX_SEED}:order'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
      AS mix_order FROM copied
    """,
)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, even_rates(docs), seed=MIX_SEED)


def even_rates(docs: DataFrame) -> DataFrame:
    """Rates that give every source, null among them, the same share of a mix of the corpus's size."""
    targets = docs.select("source").distinct().withColumn("weight", F.lit(1.0))
    return mixing.rates(docs, targets)
