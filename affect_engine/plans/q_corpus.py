"""Corpus building, audits, parallel pairs, splits."""

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import pairs as PT
from ..functions import text as X
from ..operators import corpus as C
from ..operators import splits as P
from ..operators.cleaning import clean_texts
from ..session import materialize
from .catalog import query
from .derived import SQL_CLASSES, SQL_VIEWS
from .q_text import WS, chain_sql, EARLY, LATE, TIDY, marked, q, rx, words_sql

CLASSES = "('anger','disgust','fear','joy','neutral','sadness','surprise')"
N_WORDS = f"len({words_sql('text')})"
ANN = "regexp_extract_all(labels_source, '''([^'']*)''', 1)"
SQL_VIEWS["loved"] = """
SELECT row_id, text, source, labels_source, token_count, CASE WHEN row_id % 11 = 0 THEN 'love' ELSE label END AS label FROM corpus"""
SQL_VIEWS["first_rows"] = "SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY text ORDER BY row_id) = 1"


def loved(t):
    return t.corpus.withColumn("label", F.when(F.col("row_id") % 11 == 0, "love").otherwise(F.col("label")))


@query("s6_keep_first", "SELECT row_id, label, source FROM first_rows")
def _(t):
    return C.keep_first(t.corpus.select("row_id", "label", "source", "text"), ["text"], "row_id").drop("text")


@query("s6_keep_first_cleaned", """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM docs_early GROUP BY text""")
def _(t):
    early = clean_texts(t.texts.select("doc_id", F.col("text").alias("early")), "early", X.clean_early)
    return early.groupBy("early").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("early")


@query("f10_select_sources", f"""
SELECT row_id FROM corpus WHERE source IN ('src0','src1','src2') AND (source <> 'src0' OR list_contains({ANN}, 'disgust'))""")
def _(t):
    return C.select_sources(t.corpus, ["src0", "src1", "src2"], "src0").select("row_id")


@query("f11_drop_label", "SELECT row_id FROM loved WHERE label <> 'love'")
def _(t):
    return C.drop_label(loved(t), "love").select("row_id")


@query("f12_length_filter", f"SELECT row_id FROM corpus WHERE {N_WORDS} BETWEEN 3 AND 400")
def _(t):
    return t.corpus.where(C.length_between(F.col("text"), 3, 400)).select("row_id")


@query("f13_baseline_filter", "SELECT pair_id FROM pairs WHERE length(en) > 5 AND length(ru) > 5")
def _(t):
    return C.baseline_pairs(t.pairs).select("pair_id")


@query("f15_drop_blank", "SELECT pair_id FROM (SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN NULL WHEN pair_id % 5 = 1 THEN '   ' ELSE en END AS text FROM pairs) WHERE trim(text) <> ''")
def _(t):
    k = F.col("pair_id")
    rows = t.pairs.select(k, F.when(k % 5 == 0, None).when(k % 5 == 1, "   ").otherwise(F.col("en")).alias("text"))
    return C.drop_blank(rows, "text").select("pair_id")


@query("g1_label_collapse", f"""
SELECT row_id, list_filter(['disgust','neutral','fear','sadness','surprise','anger','joy'], lambda p : list_contains({ANN}, p))[1] AS label FROM corpus""")
def _(t):
    return t.corpus.select("row_id", L.collapse_by_priority(L.parse_annotations(F.col("labels_source"))).alias("label"))


@query("g2_restore_disgust", f"""
SELECT row_id, CASE WHEN list_contains({ANN}, 'disgust') AND list_contains({ANN}, 'neutral') THEN 'neutral'
  WHEN list_contains({ANN}, 'disgust') THEN 'disgust' ELSE label END AS label FROM corpus""")
def _(t):
    return t.corpus.select("row_id", C.restore_disgust(F.col("label"), L.parse_annotations(F.col("labels_source"))).alias("label"))


@query("g2_annotation_violations", f"""
SELECT unnest(['annotated_disgust','disgust_without_annotation','overridden_not_neutral','love_left','unknown_label']) AS name,
  unnest([count(*) FILTER (d), count(*) FILTER (label = 'disgust' AND NOT d), count(*) FILTER (d AND label NOT IN ('disgust','neutral')),
    count(*) FILTER (list_contains({ANN}, 'love')), count(*) FILTER (label NOT IN {CLASSES})]) AS n
FROM (SELECT *, list_contains({ANN}, 'disgust') AS d FROM loved)""")
def _(t):
    return C.annotation_violations(loved(t))


SQL_VIEWS["src_early"] = chain_sql(EARLY, "(SELECT * FROM loved WHERE source <> 'src3')", "row_id, label")
SQL_VIEWS["src_first"] = "SELECT text, min_by(label, row_id) AS label, count(*) AS n FROM src_early GROUP BY text"
SQL_VIEWS["src_late"] = chain_sql(LATE, "src_first", "label, n")


@query("g3_build_funnel", f"""
SELECT position, step, removed::BIGINT AS removed, (total - sum(removed) OVER (ORDER BY position))::BIGINT AS rows_out FROM (
  SELECT unnest([1,2,3,4,5,6,7]) AS position, unnest(['filter_sources','normalise','deduplicate','fold_case','filter_length','tidy','drop_label']) AS step,
    unnest([outside, 0, copies, 0, short, 0, love]) AS removed, total
  FROM (SELECT (SELECT count(*) FROM loved WHERE source = 'src3') AS outside, (SELECT count(*) FROM loved) AS total,
    sum(n - 1)::BIGINT AS copies, count(*) FILTER ({N_WORDS} < 20) AS short, count(*) FILTER ({N_WORDS} >= 20 AND label = 'love') AS love FROM src_late))""")
def _(t):
    return C.build_funnel(loved(t).repartition("row_id"), F.col("source") != "src3", "love", 20)


@query("g4_multilabel_build", f"""
SELECT row_id, list_filter(['disgust','neutral','fear','sadness','surprise','anger','joy'], lambda p : list_contains(names, p))[1] AS label
FROM (SELECT row_id, list_transform(list_filter({ANN}, lambda x : x NOT IN ('anger','fear')), lambda x : CASE WHEN x = 'sadness' THEN 'joy' ELSE x END) AS names FROM first_rows) WHERE len(names) > 0""")
def _(t):
    return C.build_multilabel(t.corpus.select("row_id", "text", "labels_source"), "text", L.parse_annotations(F.col("labels_source")),
                              "row_id", ["anger", "fear"], {"sadness": "joy"}).select("row_id", "label")


SQL_VIEWS["label_rows"] = f"""
SELECT row_id, md5(row_id || '42') AS h, unnest(list_distinct({ANN})) AS label FROM corpus"""
SQL_VIEWS["label_sets"] = """
SELECT name, count(*) AS n, list(row_id ORDER BY h, row_id) AS ids
FROM (SELECT row_id, h, string_agg(label, '|' ORDER BY label) AS name FROM label_rows GROUP BY ALL) GROUP BY name"""


def greedy_sql(target: int) -> str:
    """The pick one row at a time, its state in lists over label sets and labels."""
    return f"""
WITH RECURSIVE names AS (SELECT list(label ORDER BY label) AS labels FROM (SELECT DISTINCT label FROM label_rows)),
sets AS (
  SELECT list(name ORDER BY name) AS marks, list(n ORDER BY name) AS sizes, list(ids ORDER BY name) AS ids,
    list(list_transform(string_split(name, '|'), lambda x : list_position(labels, x)) ORDER BY name) AS has, any_value(len(labels)) AS width
  FROM label_sets, names
), pick AS (
  SELECT 0 AS step, list_transform(marks, lambda x : 0) AS taken, list_transform(range(width), lambda x : {target}) AS lacking FROM sets
  UNION ALL
  SELECT step + 1, list_transform(taken, lambda t, i : t + (i = p)::INT), list_transform(lacking, lambda v, j : v - list_contains(has[p], j)::INT)
  FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, len(marks) + 1), lambda i : scores[i] = best), lambda i : {{'h': md5(marks[i] || ':' || step || ':42'), 'i': i}})).i AS p
    FROM (SELECT *, list_max(scores) AS best FROM (
      SELECT *, list_transform(range(1, len(marks) + 1), lambda i : CASE WHEN sizes[i] > taken[i] THEN list_sum(list_transform(has[i], lambda j : greatest(lacking[j], 0))) ELSE 0 END) AS scores
      FROM pick, sets)) WHERE best > 0)
), final AS (SELECT taken FROM pick ORDER BY step DESC LIMIT 1)
SELECT unnest(own) AS row_id FROM (SELECT unnest(list_transform(ids, lambda x, i : x[1:taken[i]])) AS own FROM final, sets)"""


@query("g5_balanced_downsample", greedy_sql(60))
def _(t):
    rows = t.corpus.select("row_id", F.array_distinct(L.parse_annotations(F.col("labels_source"))).alias("labels"))
    return C.balance_multilabel(rows, "row_id", "labels", 60).select("row_id")


@query("a13_class_count_violations", """
SELECT coalesce(l, e) AS name, coalesce(got, 0) AS got, coalesce(expected, 0) AS expected
FROM (SELECT label AS l, count(*) AS got FROM loved GROUP BY label) FULL JOIN
  (SELECT unnest(['anger','joy','grief']) AS e, unnest([143, 130, 5]) AS expected) ON l = e WHERE coalesce(got, 0) <> coalesce(expected, 0)""")
def _(t):
    expected = t.spark.createDataFrame([("anger", 143), ("joy", 130), ("grief", 5)], "name string, expected long")
    return C.count_violations(loved(t), "label", expected)


@query("a13_null_counts", """
SELECT unnest(['text','label','source']) AS name, unnest([count(*) FILTER (text IS NULL), count(*) FILTER (row_id % 4 = 0), count(*) FILTER (source IS NULL)]) AS nulls FROM corpus""")
def _(t):
    return C.null_counts(t.corpus.withColumn("label", F.when(F.col("row_id") % 4 != 0, F.col("label"))), ["text", "label", "source"])


@query("a14_source_signature", """
SELECT source, count(*) AS n, round(avg(regexp_matches(text, '[.,!?]')::INT), 6) AS punctuated, round(avg(regexp_matches(lower(text), 'feel|felt')::INT), 6) AS feeling,
  round(avg(regexp_matches(lower(text), '^(i feel|i felt|i am feeling)')::INT), 6) AS begins_feeling, count(DISTINCT label) AS classes FROM corpus GROUP BY source""")
def _(t):
    s = C.source_signature(t.corpus)
    return s.select("source", "n", "classes", *[F.round(c, 6).alias(c) for c in ("punctuated", "feeling", "begins_feeling")])


@query("a15_label_conflicts", """
SELECT count(*) FILTER (n > 1) AS repeated_texts, count(*) FILTER (k > 1) AS conflicting_texts, coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS rows_involved,
  count(*) FILTER (k > 1 AND d) AS involving_label, count(*) FILTER (k > 1 AND s = 1) AS within_one_source
FROM (SELECT text, count(*) AS n, count(DISTINCT label) AS k, bool_or(label = 'disgust') AS d, count(DISTINCT source) AS s FROM corpus GROUP BY text)""")
def _(t):
    return C.label_conflicts(t.corpus, "disgust")


@query("a16_register_shares", """
SELECT r AS register, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM corpus), 6) AS share
FROM (SELECT CASE WHEN source IN ('src0','src1') THEN 'a' WHEN source = 'src2' THEN 'b' ELSE 'c' END AS r FROM corpus) GROUP BY r""")
def _(t):
    register = F.when(F.col("source").isin("src0", "src1"), "a").when(F.col("source") == "src2", "b").otherwise("c")
    return C.register_shares(t.corpus, register).withColumn("share", F.round("share", 6))


@query("a16_exposure", "SELECT round(avg((source = 'src1')::INT), 6) AS share FROM corpus")
def _(t):
    return C.exposure(t.corpus, "src1").select(F.round("share", 6).alias("share"))


@query("a17_clean_share", "SELECT round(avg((c.text = d.text)::INT), 6) AS clean_share FROM docs_clean c JOIN documents d USING (doc_id)")
def _(t):
    return C.clean_share(t.texts).select(F.round("clean_share", 6).alias("clean_share"))


@query("a18_labels_per_row", f"SELECT len({ANN}) AS n_labels, count(*) AS n FROM corpus GROUP BY ALL")
def _(t):
    return C.label_profile(t.corpus, L.parse_annotations(F.col("labels_source")))


@query("a18_label_cooccurrence", f"""
SELECT a, b, count(*) AS n FROM (SELECT row_id, unnest(list_distinct({ANN})) AS a FROM corpus) JOIN
  (SELECT row_id, unnest(list_distinct({ANN})) AS b FROM corpus) USING (row_id) WHERE a < b GROUP BY a, b""")
def _(t):
    return C.label_cooccurrence(t.corpus, L.parse_annotations(F.col("labels_source")))


for _scheme, _raw in (("balanced", "n"), ("sqrt", "sqrt(n)"), ("none", "1.0")):
    query(f"a19_class_weights_{_scheme}", f"""
SELECT label, n, round(CASE WHEN '{_scheme}' = 'none' THEN 1.0 ELSE 1/{_raw} / avg(1/{_raw}) OVER () END, 6) AS weight
FROM (SELECT label, count(*) AS n FROM corpus GROUP BY label)""")(
        lambda t, s=_scheme: C.class_weights(t.corpus, "label", s).withColumn("weight", F.round("weight", 6)))


@query("a21_text_quality", " UNION ALL ".join(f"""
SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER (trim({c}) = '') AS empty, round(avg(length({c})), 6) AS mean_length,
  min(length({c})) AS min_length, max(length({c})) AS max_length, count(*) FILTER (length({c}) < 10) AS very_short, quantile_cont(length({c}), 0.5) AS median_length FROM pairs"""
    for c in ("en", "ru")))
def _(t):
    return C.text_quality(t.pairs, ["en", "ru"]).withColumn("mean_length", F.round("mean_length", 6))


@query("a27_placeholder_casing", """
SELECT unnest(['[NUM]','[num]','[URL]','[TAG]','[tag]','[NAME]']) AS name, unnest([count(*) FILTER (contains(text, '[NUM]')), count(*) FILTER (contains(text, '[num]')),
  count(*) FILTER (contains(text, '[URL]')), count(*) FILTER (contains(text, '[TAG]')), count(*) FILTER (contains(text, '[tag]')), count(*) FILTER (contains(text, '[NAME]'))]) AS n FROM marked_early""")
def _(t):
    early = clean_texts(marked(t).select("text"), "text", X.clean_early)
    return C.pattern_counts(early, {p: F.contains("text", F.lit(p)) for p in ("[NUM]", "[num]", "[URL]", "[TAG]", "[tag]", "[NAME]")})


@query("a28_stored_word_count", f"""
SELECT round(corr(token_count + row_id % 3, {N_WORDS}), 6) AS correlation, count(*) FILTER (token_count + row_id % 3 <> {N_WORDS}) AS mismatches FROM corpus""")
def _(t):
    shifted = t.corpus.withColumn("token_count", F.col("token_count") + F.col("row_id") % 3)
    return C.stored_against_counted(shifted, "token_count").withColumn("correlation", F.round("correlation", 6))


@query("a29_script_profile", f"""
SELECT round(avg((NOT regexp_matches(text, '[\\x{{400}}-\\x{{4FF}}]'))::INT), 6) AS no_cyrillic, round(avg(regexp_matches({rx('text', chr(92)+'[[^'+chr(92)+']]*'+chr(92)+']', '')}, '\\p{{Lu}}')::INT), 6) AS upper_case,
  round(avg(regexp_matches(text, {q(X.EMOJI)})::INT), 6) AS emoji, round(avg(contains(text, 'http')::INT), 6) AS link, round(avg(regexp_matches(text, '\\br/')::INT), 6) AS subreddit FROM marked""")
def _(t):
    p = C.script_profile(marked(t))
    return p.select(*[F.round(c, 6).alias(c) for c in p.columns])


SQL_VIEWS["marked_twice"] = chain_sql(EARLY + LATE + TIDY, "marked_clean")


@query("a30_recleaned_rows", """
SELECT unnest(['all','[NUM]','[TAG]','[CAPS]']) AS name, unnest([count(*), count(*) FILTER (contains(a.text, '[NUM]')), count(*) FILTER (contains(a.text, '[TAG]')), count(*) FILTER (contains(a.text, '[CAPS]'))]) AS n
FROM marked_clean a JOIN marked_twice b USING (doc_id) WHERE a.text <> b.text""")
def _(t):
    return C.recleaned_rows(marked(t), ["[NUM]", "[TAG]", "[CAPS]"])


# --- pairs -------------------------------------------------------------------

PAIR_OK = f"""length(en) BETWEEN 66 AND 3130 AND length(ru) BETWEEN 66 AND 3130 AND len({words_sql('en')}) >= 3 AND len({words_sql('ru')}) >= 3
  AND length(ru)::DOUBLE / length(en) BETWEEN 0.3 AND 3.0"""
NUMS = "list_sort(list_distinct(regexp_extract_all({x}, '\\d+')))"
SCORE = f"""round(CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE greatest(0.0, 1.0 - CASE WHEN b/a < 0.5 OR b/a > 2.0 THEN 0.2 ELSE 0 END
  - CASE WHEN len(x) > 0 AND x <> y THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(en, '[а-яё]') THEN 0.3 ELSE 0 END - CASE WHEN m/a > 0.5 THEN 0.3 ELSE 0 END) END, 6)"""
def scored_sql(source):
    return f"""
SELECT pair_id, en, ru, {SCORE} AS score, {PAIR_OK} AS ok FROM (SELECT *, len({words_sql('en')}) AS a, len({words_sql('ru')}) AS b, {NUMS.format(x='en')} AS x, {NUMS.format(x='ru')} AS y,
  coalesce(list_max(map_values(list_aggregate({words_sql('lower(en)')}, 'histogram'))), 0) AS m FROM {source})"""


SQL_VIEWS["scored_pairs"] = scored_sql("pairs")


@query("f14_pair_filter", f"SELECT pair_id FROM pairs WHERE {PAIR_OK}")
def _(t):
    return t.pairs.where(C.pair_lengths_ok(F.col("en"), F.col("ru"), 66, 3130)).select("pair_id")


@query("g6_pair_quality", "SELECT pair_id, score FROM scored_pairs")
def _(t):
    return t.pairs.select("pair_id", F.round(C.pair_quality(F.col("en"), F.col("ru")), 6).alias("score"))


@query("s7_pair_dedup", "SELECT min(pair_id) AS pair_id FROM pairs GROUP BY lower(en), lower(ru)")
def _(t):
    return C.keep_first(t.pairs, [F.lower("en"), F.lower("ru")], "pair_id").select("pair_id")


SQL_VIEWS["report_pairs"] = """
SELECT count(*) AS total_pairs, count(*) FILTER (first AND ok AND score >= 0.5) AS kept_pairs, count(*) FILTER (first AND NOT (ok AND score >= 0.5)) AS filtered_pairs, count(*) FILTER (NOT first) AS duplicates_removed
FROM (SELECT *, row_number() OVER (PARTITION BY lower(en), lower(ru) ORDER BY pair_id) = 1 AS first FROM scored_pairs)"""


@query("a20_pair_report", "SELECT total_pairs, kept_pairs, filtered_pairs, duplicates_removed FROM report_pairs")
def _(t):
    return C.pair_report(t.pairs, "pair_id", low=66, high=3130)


def pair_clean_sql(x, english):
    from ..functions import vocab
    x = f"nfc_normalize({x})"
    x = rx(x, r"[\x{200b}-\x{200f}\x{feff}]", "")
    x = f"replace({x}, chr(160), ' ')"
    if english:
        x = f"translate({x}, {q(''.join(vocab.HOMOGLYPHS))}, {q(''.join(vocab.HOMOGLYPHS.values()))})"
    x = rx(rx(rx(x, '["„‟]', '"'), "[‚]", "'"), "[—–]", "-")
    x = rx(x, WS + "+", " ")
    for symbol, name in vocab.SYMBOL_NAMES.items():
        x = f"replace({x}, {q(symbol)}, {q(name)})"
    return f"trim({x}, ' ')"


@query("t23_pair_clean", f"SELECT pair_id, {pair_clean_sql('en', True)} AS en, {pair_clean_sql('ru', False)} AS ru FROM (SELECT pair_id, 'mой α≤β ' || en AS en, ru FROM pairs)")
def _(t):
    p = t.pairs.withColumn("en", F.concat(F.lit("mой α≤β "), "en"))
    return p.select("pair_id", PT.clean_pair_text(F.col("en"), "en").alias("en"), PT.clean_pair_text(F.col("ru"), "ru").alias("ru"))


SQL_VIEWS["clean_pairs"] = f"""
SELECT * FROM (SELECT pair_id, {pair_clean_sql('en', True)} AS en, {pair_clean_sql('ru', False)} AS ru FROM pairs) WHERE en <> '' AND ru <> ''
QUALIFY row_number() OVER (PARTITION BY lower(en), lower(ru) ORDER BY pair_id) = 1"""
SQL_VIEWS["good_pairs"] = scored_sql("clean_pairs")


@query("g7_built_pairs", """
SELECT pair_id, score, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS side
FROM (SELECT pair_id, score, row_number() OVER (ORDER BY md5(pair_id || '42'), pair_id) AS rn, count(*) OVER () AS n FROM good_pairs WHERE ok AND score >= 0.5)""")
def _(t):
    good = materialize(C.build_pairs(t.pairs, "pair_id", low=66, high=3130).select("pair_id", "score"), "pairs")
    return P.shuffled_split(good, "pair_id").withColumn("score", F.round("score", 6))


# --- splits ------------------------------------------------------------------

SQL_VIEWS["text_sides"] = """
SELECT text, CASE WHEN rn <= least(g - 1, greatest(1, round_even(g * 0.15, 0))) THEN 'validation' ELSE 'train' END AS side
FROM (SELECT text, row_number() OVER (PARTITION BY c ORDER BY md5(text || '42'), text) AS rn, count(*) OVER (PARTITION BY c) AS g
      FROM (SELECT text, min_by(label, row_id) AS c FROM corpus GROUP BY text))"""


@query("p1_grouped_stratified_split", "SELECT row_id, label, side FROM corpus JOIN text_sides USING (text)")
def _(t):
    return P.grouped_stratified_split(t.corpus, "row_id", "text", "label", 0.15).select("row_id", "label", "side")


@query("p2_stratified_split", """
SELECT row_id, label, CASE WHEN rn <= round_even(g * 0.2, 0) THEN 'test' WHEN rn <= round_even(g * 0.2, 0) + round_even(g * 0.15, 0) THEN 'validation' ELSE 'train' END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '42'), row_id) AS rn, count(*) OVER (PARTITION BY label) AS g FROM corpus)""")
def _(t):
    return P.stratified_split(t.corpus.select("row_id", "label"), "row_id", "label", 0.15, 0.2)


@query("p3_stratified_folds", """
SELECT row_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '42'), row_id) - 1) % 5 AS fold FROM corpus""")
def _(t):
    return P.stratified_folds(t.corpus.select("row_id", "label"), "row_id", "label", 5)


@query("p4_shuffled_split", """
SELECT row_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS side
FROM (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '42'), row_id) AS rn, count(*) OVER () AS n FROM corpus)""")
def _(t):
    return P.shuffled_split(t.corpus.select("row_id"), "row_id")


@query("p5_holdout", """
SELECT row_id, rn <= greatest(20, floor(n * 0.1)) AS held_out FROM (SELECT row_id, row_number() OVER (ORDER BY md5(row_id || '42'), row_id) AS rn, count(*) OVER () AS n FROM corpus)""")
def _(t):
    return P.holdout(t.corpus.select("row_id"), "row_id", 0.1)


@query("s5_subsample", "SELECT row_id, label FROM corpus ORDER BY md5(row_id || '42'), row_id LIMIT 100")
def _(t):
    return P.subsample(t.corpus.select("row_id", "label"), "row_id", 100)


@query("p6_leakage_grouped", """
SELECT (SELECT count(*) FROM (SELECT text FROM corpus JOIN text_sides USING (text) GROUP BY text HAVING count(DISTINCT side) > 1)) AS leaking_texts, count(*) AS rows, 0::BIGINT AS repeated_rows FROM corpus""")
def _(t):
    return P.leakage(P.grouped_stratified_split(t.corpus, "row_id", "text", "label", 0.15), "text", "side", "row_id")


@query("p6_leakage_by_row", """
SELECT (SELECT count(*) FROM (SELECT text FROM corpus GROUP BY text HAVING count(DISTINCT row_id % 5 = 0) > 1)) AS leaking_texts, count(*) AS rows, 0::BIGINT AS repeated_rows FROM corpus""")
def _(t):
    return P.leakage(t.corpus.withColumn("side", F.col("row_id") % 5 == 0), "text", "side", "row_id")


@query("p6_shared_passages", f"""
SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i : array_to_string(w[i:i+7], ' '))) AS gram FROM (SELECT item_id, {words_sql('lower(text)')} AS w FROM benchmark) WHERE len(w) >= 8)
JOIN (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i : array_to_string(w[i:i+7], ' '))) AS gram FROM (SELECT doc_id, {words_sql('lower(text)')} AS w FROM documents) WHERE len(w) >= 8) USING (gram)""")
def _(t):
    return P.shared_passages(t.benchmark, t.documents, 8, "item_id", "doc_id")


@query("s8_union_append", """
SELECT iteration_id, model_name, f1_macro FROM experiments UNION ALL
SELECT (SELECT max(iteration_id) FROM experiments) + row_number() OVER (ORDER BY doc_id), 'new', p FROM scores""")
def _(t):
    from ..operators.experiments import append_records
    new = t.scores.select(F.col("doc_id"), F.lit("new").alias("model_name"), F.col("p").alias("f1_macro"))
    return append_records(t.experiments.select("iteration_id", "model_name", "f1_macro"), new, "iteration_id", "doc_id")


@query("s9_label_set_difference", f"""
SELECT u AS label, 'unseen' AS kind FROM (SELECT unnest({SQL_CLASSES}) AS u) WHERE u NOT IN (SELECT label FROM loved WHERE label <> 'fear') UNION ALL
SELECT DISTINCT label, 'unexpected' FROM loved WHERE label NOT IN {CLASSES} AND label <> 'fear'""")
def _(t):
    from ..operators.experiments import set_difference
    from ..functions.vocab import EMOTION_CLASSES
    expected = t.spark.createDataFrame([(c,) for c in EMOTION_CLASSES], "label string")
    return set_difference(loved(t).where("label <> 'fear'").select("label"), expected, "label")


AUDIT_SQL = f"""
SELECT 'class_count' AS kind, coalesce(l, e) AS name, abs(coalesce(got, 0) - coalesce(expected, 0)) AS n
FROM (SELECT label AS l, count(*) AS got FROM loved GROUP BY label) FULL JOIN (SELECT unnest(['anger','joy','grief']) AS e, unnest([143, 130, 5]) AS expected) ON l = e WHERE coalesce(got, 0) <> coalesce(expected, 0)
UNION ALL SELECT 'rule', name, n FROM (SELECT unnest(['disgust_without_annotation','overridden_not_neutral','unknown_label']) AS name,
  unnest([count(*) FILTER (label = 'disgust' AND NOT d), count(*) FILTER (d AND label NOT IN ('disgust','neutral')), count(*) FILTER (label NOT IN {CLASSES})]) AS n
  FROM (SELECT *, list_contains({ANN}, 'disgust') AS d FROM loved)) WHERE n > 0
UNION ALL SELECT 'conflict', 'conflicting_texts', count(*) FROM (SELECT text FROM loved GROUP BY text HAVING count(DISTINCT label) > 1) HAVING count(*) > 0"""


@query("g9_corpus_audit", AUDIT_SQL)
def _(t):
    expected = t.spark.createDataFrame([("anger", 143), ("joy", 130), ("grief", 5)], "name string, expected long")
    return C.audit(loved(t), expected)
