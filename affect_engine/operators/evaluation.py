"""Classification, calibration, ranking and regression metrics.

Rows are reduced to a small table first (a confusion table, counts per distinct
score); everything after that is independent of the data's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vocab import CONFIDENCE_GATES, EMOTION_CLASSES
from .intensity import correlation
from .scan import RANGE, by_ranges, exact_quantiles, ordered_scan, value_ranks


def confusion_cells(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Truth in rows, predictions in columns, every class present.

    Labels outside the classes, and null ones, make up the row and column ``other``.
    """

    def named(label: Column) -> Column:
        return F.when(label.isin(*EMOTION_CLASSES), label).otherwise("other")

    names = [*EMOTION_CLASSES, "other"]
    rows = df.groupBy(named(F.col(true)).alias("true")).agg(
        *[F.count_if(named(F.col(pred)) == c).alias(c) for c in names]
    )
    # One row per class of the closed class list.
    classes = df.sparkSession.createDataFrame([(c,) for c in names], "true string")
    return classes.join(rows, "true", "left").fillna(0)


def per_class_metrics(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support and predicted count per class."""
    keys = list(keys)
    long = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("c")),
                F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("c")),
            )
        ),
    )
    sums = long.groupBy(*keys, "label").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("c").alias("correct")
    )
    precision = F.coalesce(F.try_divide("correct", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("correct", "support"), F.lit(0.0))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def summary_metrics(cells: DataFrame, keys: Sequence[str] = (), present_only: bool = True) -> DataFrame:
    """Accuracy, macro averages over classes with support (or all seen), weighted F1."""
    per_class = per_class_metrics(cells, keys)
    counted = F.col("support") > 0 if present_only else F.lit(True)

    def macro(c: str) -> Column:
        return F.avg(F.when(counted, F.col(c)))

    return per_class.groupBy(*keys).agg(
        (F.sum("correct") / F.sum("support")).alias("accuracy"),
        (F.sum("correct") / F.sum("support")).alias("micro_f1"),
        macro("f1").alias("macro_f1"),
        macro("precision").alias("macro_precision"),
        macro("recall").alias("macro_recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"),
        (F.lit(len(EMOTION_CLASSES)) - F.count_if(F.col("predicted") > 0)).alias("missing_classes"),
    )


def top_confusions(cells: DataFrame, per_class: int = 3) -> DataFrame:
    """Where the errors of each class went, most frequent first."""
    from pyspark.sql import Window

    totals = cells.groupBy("true").agg(F.sum("n").alias("total"))
    # At most one row per pair of classes is ranked here.
    order = Window.partitionBy("true").orderBy(F.desc("n"), F.desc("pred"))
    return (
        cells.where(F.col("true") != F.col("pred"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_class)
        .join(totals, "true")
        .select("true", "pred", "n", "rank", (F.col("n") / F.col("total")).alias("share_of_class"))
    )


def length_effects(df: DataFrame, text: str, hit: Column) -> DataFrame:
    """Mean characters and words, median words, of hits and misses."""
    rows = df.select(hit.alias("hit"), F.length(text).alias("chars"), F.size(words(F.col(text))).alias("words"))
    plain = rows.groupBy("hit").agg(
        F.count(F.lit(1)).alias("n"), F.avg("chars").alias("mean_chars"), F.avg("words").alias("mean_words")
    )
    middle = exact_quantiles(rows, ["hit"], "words", {"median_words": 0.5})
    return plain.join(middle, "hit")


def confidence_effects(df: DataFrame, confidence: str, hit: Column, gate: float = 0.25) -> DataFrame:
    """Mean confidence of hits and misses, and what a gate keeps; null where undefined."""
    c, kept = F.col(confidence), F.col(confidence) >= gate
    wrong = ~hit
    return df.agg(
        F.avg(F.when(hit, c)).alias("correct_mean"),
        F.avg(F.when(wrong, c)).alias("incorrect_mean"),
        F.avg((~kept).cast("double")).alias("below_gate"),
        F.avg(F.when(kept, hit.cast("double"))).alias("accuracy_kept"),
        F.coalesce(F.try_divide(F.count_if(wrong & kept), F.count_if(wrong)), F.lit(0.0)).alias("errors_kept"),
    )


def threshold_sweep(df: DataFrame, confidence: str, hit: Column, gates: Sequence[float] = CONFIDENCE_GATES) -> DataFrame:
    """Coverage and cost of each gate, all gates in one pass over the rows."""
    # Rows fall into the few bands between gates; gates are applied to the bands.
    band = sum(((F.col(confidence) >= g).cast("int") for g in gates), F.lit(0))
    bands = df.groupBy(band.alias("band"), hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(float(g)).alias("threshold")) for i, g in enumerate(sorted(gates))])
    spread = bands.select("band", "hit", "n", F.inline(levels)).withColumn("kept", F.col("band") >= F.col("level"))
    n, kept, good = F.col("n"), F.col("kept"), F.col("hit")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return spread.groupBy("threshold").agg(
        (total(kept) / F.sum(n)).alias("coverage"),
        F.try_divide(total(kept & good), total(kept)).alias("accuracy_kept"),
        F.coalesce(F.try_divide(total(~kept & ~good), total(~good)), F.lit(0.0)).alias("errors_removed"),
        F.coalesce(F.try_divide(total(~kept & good), total(good)), F.lit(0.0)).alias("correct_removed"),
    )


def error_rate_by(df: DataFrame, feature: Column, hit: Column) -> DataFrame:
    return df.groupBy(feature.alias("feature")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((~hit).cast("double")).alias("error_rate")
    )


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per-class metrics of two runs side by side with their differences."""
    names = ("precision", "recall", "f1", "support")
    a = left.select("label", *[F.col(c).alias(f"a_{c}") for c in names])
    b = right.select("label", *[F.col(c).alias(f"b_{c}") for c in names])
    both = a.join(b, "label", "full_outer")
    return both.select(
        "label",
        *[F.col(f"{s}_{c}") for s in "ab" for c in names],
        *[(F.coalesce(f"b_{c}", F.lit(0.0)) - F.coalesce(f"a_{c}", F.lit(0.0))).alias(f"delta_{c}") for c in names[:3]],
    )


def macro_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Macro F1 of two runs over the classes each has support for, and the difference."""
    a = left.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("a_macro_f1"))
    b = right.agg(F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("b_macro_f1"))
    # One row each.
    return a.join(F.broadcast(b), how="cross").withColumn("delta_macro_f1", F.col("b_macro_f1") - F.col("a_macro_f1"))


def macro_auc(areas: DataFrame) -> DataFrame:
    """Mean area over the groups of ``roc_auc`` that have both classes, and their number."""
    return areas.agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("groups"))


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null without both classes."""
    group = list(keys)
    counts = df.groupBy(*group, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(positive).cast("long")).alias("pos")
    )
    dealt = by_ranges(counts, [*group, score], "score-counts")
    ranked = ordered_scan(dealt, group, [score], F.col(RANGE), sums={"below": F.col("n")})
    rank = F.col("below") + (F.col("n") + 1) / 2
    sums = ranked.groupBy(*group).agg(
        F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q")
    )
    p, q = F.col("p"), F.col("q")
    return sums.select(*group, F.try_divide(F.col("r") - p * (p + 1) / 2, p * q).alias("auc"), p.alias("positives"), q.alias("negatives"))


def multilabel_f1(df: DataFrame, label: str, p: str, y: str, threshold: float = 0.5) -> DataFrame:
    """Macro and micro F1 over (row, label) pairs cut at a probability."""
    hit = F.col(p) > threshold
    per = df.groupBy(label).agg(
        F.count_if(hit & (F.col(y) == 1)).alias("tp"),
        F.count_if(hit & (F.col(y) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(y) == 1)).alias("fn"),
    )

    def f1(tp: Column, fp: Column, fn: Column) -> Column:
        return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))

    return per.agg(
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1_macro"),
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1_micro"),
    )


def regression_metrics(df: DataFrame, keys: Sequence[str], pred: str, true: str, at_least: int = 1) -> DataFrame:
    """Errors, deviations, Pearson and Spearman; correlations null when flat."""
    keys = list(keys)
    group = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(0))
    x, y = F.col(pred), F.col(true)
    flat = (F.stddev_pop(x) < 1e-8) | (F.stddev_pop(y) < 1e-8)
    plain = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((x - y) * (x - y)).alias("mse"),
        F.avg(F.abs(x - y)).alias("mae"),
        F.stddev_pop(x).alias("pred_std"),
        F.stddev_pop(y).alias("true_std"),
        F.when(~flat, correlation(x, y)).alias("pearson"),
    ).where(F.col("n") >= at_least)
    cells = base.groupBy(*group, pred, true).agg(F.count(F.lit(1)).alias("w"))
    rx = value_ranks(base, group, pred).select(*group, pred, F.col("mean_rank").alias("rx"))
    ry = value_ranks(base, group, true).select(*group, true, F.col("mean_rank").alias("ry"))
    totals = plain.select(*group, ((F.col("n") + 1) / 2).alias("m"))
    ranked = cells.join(rx, [*group, pred]).join(ry, [*group, true]).join(totals, group)
    a, b, w = F.col("rx") - F.col("m"), F.col("ry") - F.col("m"), F.col("w")
    rho = ranked.groupBy(*group).agg(
        F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))).alias("spearman")
    )
    return plain.join(rho, group, "left").drop("__all")


def support_check(counts: DataFrame, supports: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Held-out support of each class against its share of the class count."""
    both = counts.join(supports, "label", "full_outer")
    want = F.bround(F.coalesce("n", F.lit(0)) * F.lit(fraction), 0).cast("long")
    got = F.coalesce("support", F.lit(0))
    return both.select("label", want.alias("expected"), got.alias("support"), (F.abs(want - got) <= 1).alias("ok"))


def probe_contract(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Checks on scored probes: range, spread and the order of group means."""
    v, a = F.col("valence"), F.col("arousal")
    overall = df.agg(
        F.min((v.between(0, 1) & a.between(0, 1))).alias("in_range"),
        (F.max(v) - F.min(v) > 0.15).alias("valence_spread"),
        (F.max(a) - F.min(a) > 0.15).alias("arousal_spread"),
        (F.coalesce(correlation(v, a), F.lit(0.0)) > 0.9).alias("entangled"),
    )
    per = df.groupBy(lang).agg(
        (F.avg(F.when(F.col("positive"), v)) > F.avg(F.when(~F.col("positive"), v))).alias("valence_order"),
        (F.avg(F.when(F.col("activated"), a)) > F.avg(F.when(~F.col("activated"), a))).alias("arousal_order"),
    )
    flat = overall.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in ("in_range", "valence_spread", "arousal_spread", "entangled")])))
    grouped = per.select(F.inline(F.array(*[F.struct(F.concat(F.lit(f"{c}_"), F.col(lang)).alias("check"), F.col(c).alias("ok")) for c in ("valence_order", "arousal_order")])))
    return flat.unionByName(grouped)


def label_probe_contract(df: DataFrame, at_least: int = 5, gate: float = 0.25) -> DataFrame:
    seen = [F.max((F.col("label") == c).cast("int")) for c in EMOTION_CLASSES]
    return df.agg(
        (sum(seen[1:], seen[0]) >= at_least).alias("distinct_labels_ok"),
        (F.count_if(F.col("confidence") >= gate) >= F.count(F.lit(1)) - 1).alias("confidence_ok"),
    )


