"""Classification, calibration, ranking, regression and experiment queries."""

from pyspark.sql import functions as F

from ..functions.vocab import EMOTION_CLASSES
from ..operators import evaluation as E
from ..operators.cleaning import clean_texts
from ..operators import experiments as R
from .catalog import query
from .derived import SQL_CLASSES, SQL_VIEWS
from .q_text import words_sql

def hit():
    return F.col("true_label") == F.col("pred_label")

SIX = ("precision", "recall", "f1")


def r6(df, *columns):
    """Six digits, by the double that is 1e6 times the value, as the SQL's ``round`` does.

    ``F.round`` goes by the decimal digits, which is another side for some ties, as 333/640.
    """
    double = {c for c, kind in df.dtypes if kind == "double"}
    digits = lambda c: F.round(F.col(c) * 1e6, 0) / 1e6 if c in double else F.round(c, 6)
    return df.select(*[digits(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def metrics_sql(source: str, key: str = "") -> str:
    k, on = (f"{key}, ", f"a.{key} = b.{key} AND ") if key else ("", "")
    sel = f"coalesce(a.{key}, b.{key}) AS {key}, " if key else ""
    return f"""SELECT {sel}coalesce(a.label, b.label) AS label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(correct, 0) AS correct,
  coalesce(correct::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(correct::DOUBLE / nullif(support, 0), 0) AS recall,
  coalesce(2.0 * correct / nullif(coalesce(support, 0) + coalesce(predicted, 0), 0), 0) AS f1
FROM (SELECT {k}true_label AS label, count(*) AS support, count(*) FILTER (true_label = pred_label) AS correct FROM {source} GROUP BY ALL) a
FULL JOIN (SELECT {k}pred_label AS label, count(*) AS predicted FROM {source} GROUP BY ALL) b ON {on}a.label = b.label"""


SQL_VIEWS["class_metrics"] = metrics_sql("evals")
SQL_VIEWS["slice_metrics"] = metrics_sql("evals", "lang")


@query("x1_confusion_matrix", f"""
SELECT c AS true, {', '.join(f"count(*) FILTER (p = '{c}') AS {c}" for c in (*EMOTION_CLASSES, 'other'))}
FROM (SELECT unnest(list_append({SQL_CLASSES}, 'other')) AS c) LEFT JOIN (
  SELECT CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE true_label END AS t, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE pred_label END AS p FROM evals) ON t = c GROUP BY c""")
def _(t):
    # Some labels outside the classes on either side.
    rows = t.evals.withColumns({
        "true_label": F.when(F.col("doc_id") % 11 == 0, "love").otherwise(F.col("true_label")),
        "pred_label": F.when(F.col("doc_id") % 13 != 0, F.col("pred_label"))})
    return E.confusion_matrix(rows, "true_label", "pred_label")


@query("x2_per_class_metrics", """
SELECT label, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM class_metrics""")
def _(t):
    m = E.per_class_metrics(E.confusion_cells(t.evals, "true_label", "pred_label"))
    return r6(m, *SIX).drop("correct")


SUMMARY = """round(sum(correct)::DOUBLE / sum(support), 6) AS accuracy, round(sum(correct)::DOUBLE / sum(support), 6) AS micro_f1,
  round(avg(f1) {f}, 6) AS macro_f1, round(avg(precision) {f}, 6) AS macro_precision,
  round(avg(recall) {f}, 6) AS macro_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS n,
  7 - count(*) FILTER (predicted > 0) AS missing_classes"""
NAMES = ("accuracy", "micro_f1", "macro_f1", "macro_precision", "macro_recall", "weighted_f1")


@query("x2_summary_metrics", f"SELECT {SUMMARY.format(f='FILTER (support > 0)')} FROM class_metrics")
def _(t):
    return r6(E.summary_metrics(E.confusion_cells(t.evals, "true_label", "pred_label")), *NAMES)


SQL_VIEWS["few_evals"] = "SELECT * FROM evals WHERE true_label IN ('joy', 'fear')"
SQL_VIEWS["few_metrics"] = metrics_sql("few_evals")


@query("x3_macro_over_seen_labels", f"SELECT {SUMMARY.format(f='')} FROM few_metrics")
def _(t):
    few = t.evals.where(F.col("true_label").isin("joy", "fear"))
    return r6(E.summary_metrics(E.confusion_cells(few, "true_label", "pred_label"), present_only=False), *NAMES)


@query("s4_top_confusions", """
SELECT true_label AS true, pred_label AS pred, n, rank, round(n::DOUBLE / total, 6) AS share_of_class FROM (
  SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY n DESC, pred_label DESC) AS rank FROM (
    SELECT true_label, pred_label, count(*) AS n FROM evals WHERE true_label <> pred_label GROUP BY ALL))
JOIN (SELECT true_label, count(*) AS total FROM evals GROUP BY ALL) USING (true_label) WHERE rank <= 3""")
def _(t):
    return r6(E.top_confusions(E.confusion_cells(t.evals, "true_label", "pred_label")), "share_of_class")


@query("x4_length_effects", f"""
SELECT true_label = pred_label AS hit, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, round(avg(len({words_sql('text')})), 6) AS mean_words,
  quantile_cont(len({words_sql('text')}), 0.5) AS median_words FROM evals GROUP BY 1""")
def _(t):
    return r6(E.length_effects(t.evals, "text", hit()), "mean_chars", "mean_words")


def effects_sql(gate):
    return f"""SELECT round(avg(confidence) FILTER (hit), 6) AS correct_mean, round(avg(confidence) FILTER (NOT hit), 6) AS incorrect_mean,
  round(avg((confidence < {gate})::INT), 6) AS below_gate, round(avg(hit::INT) FILTER (confidence >= {gate}), 6) AS accuracy_kept,
  round(count(*) FILTER (NOT hit AND confidence >= {gate})::DOUBLE / count(*) FILTER (NOT hit), 6) AS errors_kept
FROM (SELECT *, true_label = pred_label AS hit FROM evals)"""


@query("x5_confidence_effects", effects_sql(0.4))
def _(t):
    e = E.confidence_effects(t.evals, "confidence", hit(), 0.4)
    return r6(e, *e.columns)


@query("x9_gate_effect", effects_sql(0.25))
def _(t):
    e = E.confidence_effects(t.evals, "confidence", hit())
    return r6(e, *e.columns)


@query("x6_threshold_sweep", """
SELECT g AS threshold, round(avg((confidence >= g)::INT), 6) AS coverage, round(avg(hit::INT) FILTER (confidence >= g), 6) AS accuracy_kept,
  round(count(*) FILTER (NOT hit AND confidence < g)::DOUBLE / count(*) FILTER (NOT hit), 6) AS errors_removed,
  round(count(*) FILTER (hit AND confidence < g)::DOUBLE / count(*) FILTER (hit), 6) AS correct_removed
FROM (SELECT *, true_label = pred_label AS hit, unnest([0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]::DOUBLE[]) AS g FROM evals) GROUP BY g""")
def _(t):
    return r6(E.threshold_sweep(t.evals, "confidence", hit()), "coverage", "accuracy_kept", "errors_removed", "correct_removed")


@query("x7_error_rate_by_marker", """
SELECT contains(c.text, '[CAPS]') AS feature, count(*) AS n, round(avg((true_label <> pred_label)::INT), 6) AS error_rate
FROM evals e JOIN marked_clean c USING (doc_id) GROUP BY 1""")
def _(t):
    from .q_text import marked
    cleaned = clean_texts(marked(t).select("doc_id", "text"), "text").select("doc_id", F.contains("text", F.lit("[CAPS]")).alias("caps"))
    both = t.evals.select("doc_id", "true_label", "pred_label").join(cleaned, "doc_id")
    return r6(E.error_rate_by(both, F.col("caps"), hit()), "error_rate")


SQL_VIEWS["evals_b"] = """
SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN true_label WHEN doc_id % 10 = 1 THEN 'joy' ELSE pred_label END AS pred_label) FROM evals"""
SQL_VIEWS["class_metrics_b"] = metrics_sql("evals_b")


@query("x8_compare_runs", """
SELECT coalesce(a.label, b.label) AS label, """ + ", ".join(
    f"round({s}.{c}, 6) AS {s}_{c}" if c != "support" else f"{s}.{c} AS {s}_{c}" for s in "ab" for c in (*SIX, "support"))
    + ", " + ", ".join(f"round(coalesce(b.{c}, 0) - coalesce(a.{c}, 0), 6) AS delta_{c}" for c in SIX)
    + " FROM class_metrics a FULL JOIN class_metrics_b b ON a.label = b.label")
def _(t):
    k = F.col("doc_id")
    other = t.evals.withColumn("pred_label", F.when(k % 3 == 0, F.col("true_label")).when(k % 10 == 1, "joy").otherwise(F.col("pred_label")))
    runs = [E.per_class_metrics(E.confusion_cells(d, "true_label", "pred_label")) for d in (t.evals, other)]
    out = E.compare_runs(*runs)
    return r6(out, *[c for c in out.columns if c != "label" and "support" not in c])


@query("x8_macro_delta", """
SELECT round(a, 6) AS a_macro_f1, round(b, 6) AS b_macro_f1, round(b - a, 6) AS delta_macro_f1
FROM (SELECT avg(f1) FILTER (support > 0) AS a FROM class_metrics), (SELECT avg(f1) FILTER (support > 0) AS b FROM class_metrics_b)""")
def _(t):
    k = F.col("doc_id")
    other = t.evals.withColumn("pred_label", F.when(k % 3 == 0, F.col("true_label")).when(k % 10 == 1, "joy").otherwise(F.col("pred_label")))
    runs = [E.per_class_metrics(E.confusion_cells(d, "true_label", "pred_label")) for d in (t.evals, other)]
    return r6(E.macro_delta(*runs), "a_macro_f1", "b_macro_f1", "delta_macro_f1")


@query("x19_metrics_per_slice", f"""
SELECT lang, {SUMMARY.format(f='FILTER (support > 0)')} FROM slice_metrics GROUP BY lang""")
def _(t):
    return r6(E.summary_metrics(E.confusion_cells(t.evals, "true_label", "pred_label", ["lang"]), ["lang"]), *NAMES)


SQL_VIEWS["multi"] = """
SELECT doc_id, 'quality' AS label, p, quality AS y FROM scores UNION ALL SELECT doc_id, 'toxic', 1.2 - p - toxic * 0.05::DOUBLE, toxic FROM scores"""


def multi(t):
    return t.scores.select("doc_id", F.inline(F.array(
        F.struct(F.lit("quality").alias("label"), F.col("p").alias("p"), F.col("quality").alias("y")),
        F.struct(F.lit("toxic").alias("label"), (1.2 - F.col("p") - F.col("toxic") * 0.05).alias("p"), F.col("toxic").alias("y")))))


AUC = """SELECT {k}, round((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc, n1 AS positives, n0 AS negatives FROM (
  SELECT *, rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2.0 AS r,
    count(*) FILTER (y = 1) OVER (PARTITION BY {k}) AS n1, count(*) FILTER (y = 0) OVER (PARTITION BY {k}) AS n0 FROM {s}) GROUP BY {k}, n1, n0"""


@query("x12_roc_auc", AUC.format(k="label", s="multi"))
def _(t):
    return r6(E.roc_auc(multi(t), ["label"], "p", "y"), "auc")


@query("x12_macro_auc", f"SELECT round(avg(auc), 6) AS macro_auc, count(auc) AS groups FROM ({AUC.format(k='label', s='multi').replace('round(', '(').replace(', 6)', ')')})")
def _(t):
    return r6(E.macro_auc(E.roc_auc(multi(t), ["label"], "p", "y")), "macro_auc")


@query("x12_multilabel_f1", """
SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS f1_macro, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro
FROM (SELECT label, count(*) FILTER (p > 0.5 AND y = 1) AS tp, count(*) FILTER (p > 0.5 AND y = 0) AS fp, count(*) FILTER (p <= 0.5 AND y = 1) AS fn FROM multi GROUP BY label)""")
def _(t):
    out = E.multilabel_f1(multi(t), "label", "p", "y")
    return r6(out, *out.columns)


SQL_VIEWS["ranked_va"] = """
SELECT 'valence' AS dimension, v.valence AS p, (distil_label = 'joy')::INT AS y FROM va v JOIN predictions USING (video_id, segment_id)
  WHERE valence IS NOT NULL AND distil_label IN ('joy', 'anger', 'fear', 'sadness', 'disgust')
UNION ALL SELECT 'arousal', v.arousal, (distil_label IN ('anger', 'fear', 'surprise'))::INT FROM va v JOIN predictions USING (video_id, segment_id)
  WHERE arousal IS NOT NULL AND distil_label IN ('anger', 'fear', 'surprise', 'sadness', 'neutral')"""


@query("x13_class_pair_auc", AUC.format(k="dimension", s="ranked_va"))
def _(t):
    both = t.va_keys.join(t.predictions.select("video_id", "segment_id", "distil_label"), ["video_id", "segment_id"])
    label = F.col("distil_label")
    valence = both.where(F.col("valence").isNotNull() & label.isin("joy", "anger", "fear", "sadness", "disgust")).select(
        F.lit("valence").alias("dimension"), F.col("valence").alias("p"), (label == "joy").cast("int").alias("y"))
    arousal = both.where(F.col("arousal").isNotNull() & label.isin("anger", "fear", "surprise", "sadness", "neutral")).select(
        F.lit("arousal").alias("dimension"), F.col("arousal").alias("p"), label.isin("anger", "fear", "surprise").cast("int").alias("y"))
    return r6(E.roc_auc(valence.unionByName(arousal), ["dimension"], "p", "y"), "auc")


def regression_sql(source, k=None, having=""):
    part = f"PARTITION BY {k}" if k else ""
    sel = f"{k}, " if k else ""
    group = f"GROUP BY {k}" if k else ""
    return f"""SELECT {sel}count(*) AS n, round(avg((pred - truth)*(pred - truth)), 6) AS mse, round(avg(abs(pred - truth)), 6) AS mae,
  round(stddev_pop(pred), 6) AS pred_std, round(stddev_pop(truth), 6) AS true_std, round(corr(pred, truth), 6) AS pearson, round(corr(rx, ry), 6) AS spearman
FROM (SELECT *, rank() OVER ({part} ORDER BY pred) + (count(*) OVER (PARTITION BY {sel}pred) - 1)/2.0 AS rx,
  rank() OVER ({part} ORDER BY truth) + (count(*) OVER (PARTITION BY {sel}truth) - 1)/2.0 AS ry FROM {source}) {group} {having}"""


REG = ("mse", "mae", "pred_std", "true_std", "pearson", "spearman")


@query("x10_regression_metrics", regression_sql("scores"))
def _(t):
    return r6(E.regression_metrics(t.scores, [], "pred", "truth"), *REG)


SQL_VIEWS["lang_scores"] = "SELECT s.*, lang FROM scores s JOIN documents USING (doc_id)"


@query("x11_regression_per_language", regression_sql("lang_scores", "lang", "HAVING count(*) >= 20"))
def _(t):
    rows = t.scores.join(t.documents.select("doc_id", "lang"), "doc_id")
    return r6(E.regression_metrics(rows, ["lang"], "pred", "truth", at_least=20), *REG)


SQL_VIEWS["probes"] = """
SELECT segment_id, CASE WHEN video_id % 2 = 0 THEN 'ru' ELSE 'en' END AS lang, valence, arousal, valence + segment_id * 0.05 > 0.5 AS positive, arousal > 0.4 AS activated
FROM va WHERE valence IS NOT NULL"""


@query("x14_probe_contract", """
SELECT unnest(['in_range','valence_spread','arousal_spread','entangled']) AS check, unnest([bool_and(valence BETWEEN 0 AND 1 AND arousal BETWEEN 0 AND 1),
  max(valence) - min(valence) > 0.15, max(arousal) - min(arousal) > 0.15, coalesce(corr(valence, arousal), 0) > 0.9]) AS ok FROM probes UNION ALL
SELECT unnest(['valence_order_' || lang, 'arousal_order_' || lang]), unnest([avg(valence) FILTER (positive) > avg(valence) FILTER (NOT positive), avg(arousal) FILTER (activated) > avg(arousal) FILTER (NOT activated)]) FROM probes GROUP BY lang""")
def _(t):
    va = t.va_keys.where("valence is not null").select(
        F.when(F.col("video_id") % 2 == 0, "ru").otherwise("en").alias("lang"), "valence", "arousal",
        (F.col("valence") + F.col("segment_id") * 0.05 > 0.5).alias("positive"), (F.col("arousal") > 0.4).alias("activated"))
    return E.probe_contract(va)


@query("x15_label_probe_contract", """
SELECT count(DISTINCT pred_label) >= 5 AS distinct_labels_ok, count(*) FILTER (confidence >= 0.25) >= count(*) - 1 AS confidence_ok FROM evals""")
def _(t):
    return E.label_probe_contract(t.evals.withColumn("label", F.col("pred_label")))


@query("x18_support_check", """
SELECT coalesce(a.label, b.label) AS label, round_even(coalesce(n, 0) * 0.15, 0)::BIGINT AS expected, coalesce(s, 0) AS support,
  abs(round_even(coalesce(n, 0) * 0.15, 0) - coalesce(s, 0)) <= 1 AS ok
FROM (SELECT label, count(*) AS n FROM corpus GROUP BY label) a FULL JOIN (SELECT label, count(*) AS s FROM corpus JOIN text_sides USING (text) WHERE side = 'validation' GROUP BY label) b ON a.label = b.label""")
def _(t):
    from ..operators import splits as P
    counts = t.corpus.groupBy("label").agg(F.count("*").alias("n"))
    held = P.grouped_stratified_split(t.corpus, "row_id", "text", "label", 0.15).where("side = 'validation'")
    return E.support_check(counts, held.groupBy("label").agg(F.count("*").alias("support")))


# --- experiments -------------------------------------------------------------

SQL_VIEWS["latest"] = "SELECT * FROM experiments QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY iteration_id DESC) = 1"


@query("w8_latest_then_best", "SELECT model_name, model_type, f1_macro FROM latest ORDER BY f1_macro DESC, model_name LIMIT 5")
def _(t):
    last = R.latest_per(t.experiments, "model_name", "iteration_id")
    return R.best(last, "f1_macro", 5, "model_name").select("model_name", "model_type", "f1_macro")


@query("s3_sorted_grid_results", "SELECT iteration_id, f1_macro FROM experiments ORDER BY f1_macro DESC, iteration_id LIMIT 5")
def _(t):
    return R.best(t.experiments, "f1_macro", 5, "iteration_id").select("iteration_id", "f1_macro")


@query("s10_best_per_model", """
SELECT model_name, iteration_id FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY coalesce(CASE WHEN iteration_id % 7 <> 0 THEN f1_macro END, -1) DESC, iteration_id) AS rn FROM experiments) WHERE rn = 1""")
def _(t):
    score = F.when(F.col("iteration_id") % 7 == 0, float("nan")).otherwise(F.col("f1_macro"))
    return R.best_per(t.experiments, "model_name", score, "iteration_id").select("model_name", "iteration_id")


@query("x16_experiment_report", """
SELECT count(*) AS total_models, count(*) FILTER (f1_macro >= 0.75) AS models_above_threshold, arg_max(model_name, (f1_macro, model_name)) AS best_model,
  arg_min(model_name, (f1_macro, model_name)) AS worst_model, max(f1_macro) AS best_score, round(avg(f1_macro), 6) AS average_score FROM latest""")
def _(t):
    return r6(R.report(t.experiments, "model_name", "iteration_id", "f1_macro"), "average_score")


@query("x16_best_by_type", "SELECT model_type, max(f1_macro) AS best_score FROM latest GROUP BY model_type")
def _(t):
    return R.best_by_type(t.experiments, "model_name", "iteration_id", "model_type", "f1_macro")


@query("x16_winner", """
SELECT arg_min(r, low) AS winner, min(low) AS best_loss, round((max(low) - min(low)) / max(low) * 100, 6) AS improvement
FROM (SELECT CASE WHEN iteration_id % 2 = 0 THEN 'a' ELSE 'b' END AS r, min(f1_macro + iteration_id % 2 * 0.25 + 0.1) AS low FROM experiments GROUP BY 1)""")
def _(t):
    k = F.col("iteration_id")
    runs = t.experiments.select(F.when(k % 2 == 0, "a").otherwise("b").alias("run"), (F.col("f1_macro") + k % 2 * 0.25 + 0.1).alias("loss"))
    return r6(R.winner(runs, "run", "loss"), "improvement")


@query("j8_unseen_models", "SELECT DISTINCT model_name FROM experiments WHERE model_name NOT IN (SELECT model_name FROM experiments WHERE f1_macro > 0.998)")
def _(t):
    e = t.experiments
    return e.select("model_name").distinct().join(e.where("f1_macro > 0.998"), "model_name", "left_anti")
