"""Building and auditing labelled corpora and parallel pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import collapse_by_priority, literal_map, parse_annotations
from ..functions.pairs import clean_pair_text
from ..functions.text import clean_early, clean_late, let, words
from ..functions.vocab import EMOTION_CLASSES
from .cleaning import clean_texts
from .intensity import correlation
from .scan import RANGE, by_ranges, exact_quantiles, ordered_scan


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: str) -> DataFrame:
    """One row per key, the earliest by ``order``.

    An aggregate rather than a window: copies are merged before the shuffle,
    so a text that makes up a third of the rows costs nothing. Rows are grouped by
    128-bit digests, so a long key is neither shuffled nor sorted.
    """
    named = [F.md5((F.col(k) if isinstance(k, str) else k).cast("string")) for k in keys]
    tagged = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(named)])
    return (
        tagged.groupBy(*[f"__k{i}" for i in range(len(named))])
        .agg(F.min_by(F.struct(*df.columns), order).alias("__row"))
        .select("__row.*")
    )


def select_sources(
    df: DataFrame, sources: Sequence[str], partial: str, wanted: str = "disgust"
) -> DataFrame:
    """Rows of the chosen sources; of ``partial`` only those annotated ``wanted``."""
    annotated = F.array_contains(parse_annotations(F.col("labels_source")), wanted)
    return df.where(
        F.col("source").isin(list(sources)) & ((F.col("source") != partial) | annotated)
    )


def drop_label(df: DataFrame, label: str) -> DataFrame:
    """Rows without one label; rows without any label stay."""
    return df.where(~F.col("label").eqNullSafe(label))


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.trim(text) != "")


def baseline_pairs(df: DataFrame, left: str = "en", right: str = "ru", longer_than: int = 5) -> DataFrame:
    """Pairs with both sides beyond a length."""
    return df.where((F.length(left) > longer_than) & (F.length(right) > longer_than))


def length_between(text: Column, low: int, high: int | None = None) -> Column:
    n = F.size(words(text))
    return (n >= low) if high is None else n.between(low, high)


def restore_disgust(label: Column, annotations: Column) -> Column:
    """Annotated disgust overrules the label; annotated with neutral it is neutral."""
    disgust = F.array_contains(annotations, "disgust")
    neutral = F.array_contains(annotations, "neutral")
    return F.when(disgust & neutral, "neutral").when(disgust, "disgust").otherwise(label)


def build_funnel(
    df: DataFrame, kept_source: Column, drop_label: str, min_words: int
) -> DataFrame:
    """Rows removed and left after each build step.

    Each row is charged to the step that drops it. Deduplication is counted
    per text, never by gathering the copies.
    """
    sourced = df.withColumn("__kept", kept_source)
    outside = sourced.where(~F.col("__kept")).agg(F.count(F.lit(1)).alias("n"))
    texts = (
        clean_texts(sourced.where("__kept").select("row_id", "label", F.col("text").alias("__early")), "__early", clean_early)
        .groupBy("__early")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("label", "row_id").alias("label"))
    )
    short = ~length_between(clean_late(F.col("__early")), min_words)
    fate = texts.withColumn("__short", short).agg(
        F.sum(F.col("n") - 1).alias("copies"),
        F.count_if("__short").alias("short"),
        F.count_if(~F.col("__short") & (F.col("label") == drop_label)).alias("label"),
        F.count_if(~F.col("__short") & (F.col("label") != drop_label)).alias("kept"),
    )
    # Two one-row totals.
    both = outside.join(F.broadcast(fate), how="cross")
    steps = [
        ("filter_sources", F.col("n")),
        ("normalise", F.lit(0)),
        ("deduplicate", F.col("copies")),
        ("fold_case", F.lit(0)),
        ("filter_length", F.col("short")),
        ("tidy", F.lit(0)),
        ("drop_label", F.col("label")),
    ]
    left = F.col("kept")
    rows = []
    for position, (name, removed) in reversed(list(enumerate(steps, 1))):
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("step"),
                removed.cast("long").alias("removed"),
                left.cast("long").alias("rows_out"),
            )
        )
        left = left + removed
    return both.select(F.inline(F.array(*rows)))


def build_multilabel(
    df: DataFrame, text: str, labels: Column, order: str, dropped: Sequence[str], renamed: Mapping
) -> DataFrame:
    """Deduplicate, remove labels, drop unlabelled rows, collapse by priority."""
    first = keep_first(df.withColumn("__labels", labels), [text], order)
    kept = F.filter("__labels", lambda x: ~x.isin(list(dropped)))
    table = literal_map(dict(renamed))
    mapped = F.transform(kept, lambda x: F.coalesce(table[x], x)) if renamed else kept
    return (
        first.withColumn("__labels", mapped)
        .where(F.size("__labels") > 0)
        .withColumn("label", collapse_by_priority(F.col("__labels")))
        .drop("__labels")
    )


def greedy_picks(sets: Sequence[tuple[Sequence[str], int]], target: int, seed: str) -> list[int]:
    """How many rows of each label set a one-by-one greedy pick takes.

    ``sets`` lists (labels, number of rows). Each step takes a row of the set whose
    labels lack the most rows together; ties are drawn by a seeded hash.
    """
    names = {label: i for i, label in enumerate(sorted({x for labels, _ in sets for x in labels}))}
    has = np.zeros((len(sets), len(names)), np.int64)
    for i, (labels, _) in enumerate(sets):
        has[i, [names[x] for x in labels]] = 1
    left = np.array([n for _, n in sets], np.int64)
    lacking = np.full(len(names), target, np.int64)
    taken = np.zeros(len(sets), np.int64)
    marks = ["|".join(labels) for labels, _ in sets]
    step = 0
    while len(sets):
        score = np.where(left > 0, has @ np.maximum(lacking, 0), 0)
        best = score.max()
        if best <= 0:
            break
        ties = np.flatnonzero(score == best)
        pick = min(ties, key=lambda i: hashlib.md5(f"{marks[i]}:{step}:{seed}".encode()).hexdigest())
        taken[pick] += 1
        left[pick] -= 1
        lacking -= has[pick]
        step += 1
    return taken.tolist()


def balance_multilabel(
    df: DataFrame, key: str, labels: str, target: int, seed: str = "42"
) -> DataFrame:
    """Rows chosen greedily until every label has ``target`` where supply allows.

    A greedy pick takes, one by one, a row whose labels lack the most rows
    together. Rows with the same labels are as good as each other, so the pick
    runs on the number of rows per label set, of which there are few whatever
    the number of rows; each set then gives its first rows in a seeded order.
    """
    spark = df.sparkSession
    marked = df.select(key, F.array_sort(F.array_distinct(labels)).alias("__set")).where(F.size("__set") > 0)
    sets = [(list(r["__set"]), r["__n"]) for r in marked.groupBy("__set").agg(F.count(F.lit(1)).alias("__n")).collect()]
    taken = greedy_picks(sets, target, seed)
    wanted = spark.createDataFrame([(s, t) for (s, _), t in zip(sets, taken, strict=True) if t], "__set array<string>, __take long")
    rows = marked.join(wanted, "__set").withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))))
    name = F.array_join("__set", "\x1f")
    dealt = by_ranges(rows.select(key, name.alias("__set"), "__h", "__take"), ["__set", "__h", key], "label-sets")
    ranked = ordered_scan(dealt, ["__set"], ["__h", key], F.col(RANGE), position="rank")
    return df.join(ranked.where(F.col("rank") <= F.col("__take")).select(key), key, "left_semi")


def hash_chunk(digest: Column, digits: int = 3) -> Column:
    """Chunk of an md5 order: its first hex digits, even chunks.

    Three digits suit groups of up to some hundred million rows; take one more
    for every factor of 16.
    """
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


# --- audits ------------------------------------------------------------------


def count_violations(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Values whose count differs from the expected table, either side missing."""
    got = df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("got"))
    both = got.join(expected.select("name", "expected"), "name", "full_outer")
    return both.select(
        "name", F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("expected", F.lit(0)).alias("expected")
    ).where("got <> expected")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in columns]))
    )


def source_signature(df: DataFrame) -> DataFrame:
    """What gives a source away: punctuation, feeling words, its classes."""
    low = F.lower("text")
    per_label = df.groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("text").alias("texts"),
        F.count_if(F.col("text").rlike(r"[.,!?]")).alias("punctuated"),
        F.count_if(low.rlike("feel|felt")).alias("feeling"),
        F.count_if(low.rlike("^(i feel|i felt|i am feeling)")).alias("begins_feeling"),
    )
    shares = [F.try_divide(F.sum(c), F.sum("texts")).alias(c) for c in ("punctuated", "feeling", "begins_feeling")]
    return per_label.groupBy("source").agg(F.sum("n").alias("n"), *shares, F.count("label").alias("classes"))


def label_conflicts(df: DataFrame, involving: str) -> DataFrame:
    """Repeated texts and those labelled in more than one way.

    Any label counts, also one outside the classes; a null label counts as none.
    Copies collapse to one row per (text, label) before a text is looked at as a
    whole.
    """
    cells = df.groupBy("text", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("source").alias("low"), F.max("source").alias("high")
    )
    per_text = cells.groupBy("text").agg(
        F.sum("n").alias("rows"),
        F.count("label").alias("labels"),
        F.max(F.col("label") == involving).alias("involved"),
        (F.min("low") == F.max("high")).alias("one_source"),
    )
    conflict = F.col("labels") > 1
    return per_text.agg(
        F.count_if(F.col("rows") > 1).alias("repeated_texts"),
        F.count_if(conflict).alias("conflicting_texts"),
        F.sum(F.when(conflict, F.col("rows")).otherwise(0)).alias("rows_involved"),
        F.count_if(conflict & F.col("involved")).alias("involving_label"),
        F.count_if(conflict & F.col("one_source")).alias("within_one_source"),
    )


def register_shares(df: DataFrame, register: Column) -> DataFrame:
    counts = df.groupBy(register.alias("register")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.join(F.broadcast(total), how="cross").select(
        "register", "n", (F.col("n") / F.col("__t")).alias("share")
    )


def exposure(df: DataFrame, source: str) -> DataFrame:
    return df.agg(F.coalesce(F.avg((F.col("source") == source).cast("double")), F.lit(0.0)).alias("share"))


def clean_share(df: DataFrame) -> DataFrame:
    """Share of texts the normaliser leaves as they are."""
    both = clean_texts(df.select("text", F.col("text").alias("__clean")), "__clean")
    return both.agg(F.avg((F.col("__clean") == F.col("text")).cast("double")).alias("clean_share"))


def label_profile(df: DataFrame, labels: Column) -> DataFrame:
    """Rows per number of labels, including unlabelled rows."""
    return df.groupBy(F.size(labels).alias("n_labels")).agg(F.count(F.lit(1)).alias("n"))


def label_cooccurrence(df: DataFrame, labels: Column) -> DataFrame:
    """Rows carrying both labels of each pair; a row has few distinct labels."""
    distinct = F.array_sort(F.array_distinct(labels))
    first = df.select(distinct.alias("__l")).select("__l", F.posexplode("__l").alias("__i", "a"))
    rest = F.slice("__l", F.col("__i") + 2, F.greatest(F.size("__l"), F.lit(1)))
    return (
        first.select("a", F.explode(rest).alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def text_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing, empty, very short and the length figures of each text column."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("text")) for c in columns]))
    ).withColumn("len", F.length("text"))
    plain = long.groupBy("name").agg(
        F.count_if(F.col("text").isNull()).alias("missing"),
        F.count_if(F.trim("text") == "").alias("empty"),
        F.avg("len").alias("mean_length"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
        F.count_if(F.col("len") < 10).alias("very_short"),
    )
    middle = exact_quantiles(long, ["name"], "len", {"median_length": 0.5})
    return plain.join(middle, "name", "left")


def pattern_counts(df: DataFrame, patterns: Mapping[str, Column]) -> DataFrame:
    """Rows matching each named condition, in one pass."""
    counted = df.agg(*[F.count_if(c).alias(f"__c{i}") for i, c in enumerate(patterns.values())])
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"__c{i}").alias("n")) for i, n in enumerate(patterns)]
    return counted.select(F.inline(F.array(*rows)))


def script_profile(df: DataFrame) -> DataFrame:
    """Share of rows without Cyrillic, with capitals, emoji, links, subreddits."""
    from ..functions.text import EMOJI

    bare = F.regexp_replace("text", r"\[[^\]]*\]", "")
    tests = {
        "no_cyrillic": ~F.col("text").rlike(r"[\x{400}-\x{4FF}]"),
        "upper_case": bare.rlike(r"\p{Lu}"),
        "emoji": F.col("text").rlike(EMOJI),
        "link": F.contains("text", F.lit("http")),
        "subreddit": F.col("text").rlike(r"\br/"),
    }
    return df.agg(*[F.avg(c.cast("double")).alias(n) for n, c in tests.items()])


def recleaned_rows(df: DataFrame, placeholders: Sequence[str]) -> DataFrame:
    """Rows a second cleaning changes, by the placeholder they hold."""
    once = clean_texts(df.select(F.col("text").alias("once")), "once")
    twice = clean_texts(once.withColumn("twice", F.col("once")), "twice")
    seen = twice.select("once", (F.col("twice") != F.col("once")).alias("changed"))
    marks = {p: F.col("changed") & F.contains("once", F.lit(p)) for p in placeholders}
    return pattern_counts(seen, {"all": F.col("changed"), **marks})


def stored_against_counted(df: DataFrame, stored: str) -> DataFrame:
    """Correlation and mismatches of a stored word count and a recount."""
    both = df.select(F.col(stored).cast("double").alias("a"), F.size(words(F.col("text"))).cast("double").alias("b"))
    return both.agg(
        correlation(F.col("a"), F.col("b")).alias("correlation"),
        F.count_if(F.col("a") != F.col("b")).alias("mismatches"),
    )


def class_weights(df: DataFrame, label: str, scheme: str = "balanced") -> DataFrame:
    """Weight per class, mean 1; a class without rows is an error."""
    if scheme not in ("none", "balanced", "sqrt"):
        raise ValueError(f"unknown class-weight scheme {scheme!r}")
    k = len(EMOTION_CLASSES)
    # One row, one column per class: the class list is closed.
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(label) == c).alias(c) for c in EMOTION_CLASSES],
    )

    def weight(c: str) -> Column:
        if scheme == "none":
            return F.lit(1.0)
        raw = F.col("__n") / (F.lit(k) * F.col(c))
        raw = F.sqrt(raw) if scheme == "sqrt" else raw
        absent = F.raise_error(F.lit(f"cannot weight absent class {c}")).cast("double")
        return F.when(F.col(c) > 0, raw).otherwise(absent)

    raws = F.array(*[weight(c) for c in EMOTION_CLASSES])
    mean = let(raws, lambda a: F.transform(a, lambda x: x * k / F.aggregate(a, F.lit(0.0), lambda s, v: s + v)))
    return counts.withColumn("__w", mean).select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n"), F.col("__w")[i].alias("weight")) for i, c in enumerate(EMOTION_CLASSES)])
        )
    )


def annotation_violations(df: DataFrame) -> DataFrame:
    """Rows breaking the rules that tie labels to their source annotations."""
    names = parse_annotations(F.col("labels_source"))
    tagged = df.withColumn("__disgust", F.array_contains(names, "disgust")).withColumn(
        "__love", F.array_contains(names, "love")
    )
    is_disgust = F.lower("label") == "disgust"
    return pattern_counts(
        tagged,
        {
            "annotated_disgust": F.col("__disgust"),
            "disgust_without_annotation": is_disgust & ~F.col("__disgust"),
            "overridden_not_neutral": F.col("__disgust") & ~is_disgust & (F.lower("label") != "neutral"),
            "love_left": F.col("__love"),
            "unknown_label": ~F.lower("label").isin(list(EMOTION_CLASSES)),
        },
    )


def audit(df: DataFrame, expected: DataFrame) -> DataFrame:
    """All problems of a corpus in one table: kind, name and size; empty when clean."""
    counts = count_violations(df, "label", expected).select(
        F.lit("class_count").alias("kind"), "name", F.abs(F.col("got") - F.col("expected")).alias("n")
    )
    rules = annotation_violations(df).where(F.col("name") != "annotated_disgust").select(
        F.lit("rule").alias("kind"), "name", "n"
    )
    nulls = null_counts(df, ["text", "label", "source", "labels_source", "token_count"]).select(
        F.lit("null").alias("kind"), "name", F.col("nulls").alias("n")
    )
    conflicts = label_conflicts(df, "disgust").select(
        F.lit("conflict").alias("kind"), F.lit("conflicting_texts").alias("name"), F.col("conflicting_texts").alias("n")
    )
    return counts.unionByName(rules).unionByName(nulls).unionByName(conflicts).where("n > 0")


# --- parallel pairs ----------------------------------------------------------


def pair_lengths_ok(en: Column, ru: Column, low: int = 66, high: int = 313) -> Column:
    """Both sides long enough, not too long, at least three words, similar length."""
    a, b = F.length(en), F.length(ru)
    return (
        a.between(low, high)
        & b.between(low, high)
        & (F.size(words(en)) >= 3)
        & (F.size(words(ru)) >= 3)
        & F.try_divide(b, a).between(0.3, 3.0)
    )


def pair_quality(en: Column, ru: Column) -> Column:
    """1 less a penalty per fault, never below 0."""

    def score(x: Column) -> Column:
        a, b = F.size(x["a"]), F.size(x["b"])
        ratio = F.try_divide(b.cast("double"), a)
        sorted_words = F.array_sort(F.transform(x["a"], lambda w: F.lower(w)))
        start = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def count(acc: Column, w: Column) -> Column:
            run = F.when(acc["w"] == w, acc["run"] + 1).otherwise(1)
            return F.struct(w.alias("w"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        most = F.aggregate(sorted_words, start, count)["best"]
        nums_differ = (F.size(x["ea"]) > 0) & (x["ea"] != x["rb"])
        total = (
            F.lit(1.0)
            - F.when((ratio < 0.5) | (ratio > 2.0), 0.2).otherwise(0.0)
            - F.when(nums_differ, 0.15).otherwise(0.0)
            - F.when(x["en"].rlike("[а-яё]"), 0.3).otherwise(0.0)
            - F.when(F.try_divide(most.cast("double"), a) > 0.5, 0.3).otherwise(0.0)
        )
        return F.when((a == 0) | (b == 0), 0.0).otherwise(F.greatest(F.lit(0.0), total))

    def numbers(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\d+"), 0)))

    return let(
        F.struct(en.alias("en"), words(en).alias("a"), words(ru).alias("b"), numbers(en).alias("ea"), numbers(ru).alias("rb")),
        score,
    )


def _rows_where(df: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows that ``keep`` takes. A plain filter would work out the columns it reads a second time."""
    return df.select(F.inline(F.filter(F.array(F.struct(*df.columns)), keep)))


def build_pairs(
    pairs: DataFrame, key: str, threshold: float = 0.5, low: int = 66, high: int = 313
) -> DataFrame:
    """Clean, drop empty sides and later copies, filter by length, keep good pairs."""
    cleaned = pairs.select(
        key, clean_pair_text(F.col("en"), "en").alias("en"), clean_pair_text(F.col("ru"), "ru").alias("ru")
    )
    cleaned = _rows_where(cleaned, lambda r: (r["en"] != "") & (r["ru"] != ""))
    first = keep_first(cleaned, [F.lower("en"), F.lower("ru")], key)
    fitting = first.where(pair_lengths_ok(F.col("en"), F.col("ru"), low, high))
    scored = fitting.withColumn("score", pair_quality(F.col("en"), F.col("ru")))
    return _rows_where(scored, lambda r: r["score"] >= threshold)


def pair_report(
    pairs: DataFrame, key: str, threshold: float = 0.5, low: int = 66, high: int = 313
) -> DataFrame:
    """Pairs tagged kept, duplicate or filtered; duplicates fall before the filters."""
    blank = (F.trim("en") == "") | (F.trim("ru") == "")
    full = pairs.where(~blank)
    empty = pairs.where(blank).agg(F.count(F.lit(1)).alias("empty"))
    groups = full.groupBy(F.lower("en").alias("__e"), F.lower("ru").alias("__r")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("en", "ru"), key).alias("p")
    )
    ok = pair_lengths_ok(F.col("p.en"), F.col("p.ru"), low, high) & (
        pair_quality(F.col("p.en"), F.col("p.ru")) >= threshold
    )
    tallied = groups.withColumn("__ok", ok).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("full"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if("__ok").alias("kept_pairs"),
        F.count_if(~F.col("__ok")).alias("failed"),
    )
    return tallied.join(F.broadcast(empty), how="cross").select(
        (F.col("full") + F.col("empty")).alias("total_pairs"),
        "kept_pairs",
        (F.col("failed") + F.col("empty")).alias("filtered_pairs"),
        "duplicates_removed",
    )
