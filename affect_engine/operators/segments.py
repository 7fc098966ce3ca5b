"""Timed words to sentences to segments, without collecting a scene.

Every rule of the splitter looks only at neighbouring words, so sentences are
cut on the word stream itself; positions are running sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sentences import CAPITAL, cosine, jaccard, overlap_words
from ..functions.text import words as split_words
from ..session import materialize
from .greedy import Extent, follow
from .scan import chunk_of, exact_quantiles, nested_chunk, ordered_scan

SCENE = ["video_id", "global_scene_id"]
WORD_CHUNK = 4096


@dataclass(frozen=True)
class Limits:
    min_words: int = 6
    target_words: int = 15
    max_words: int = 30
    max_sentences: int = 4
    min_similarity: float = 0.35


def sequential_ids(words: DataFrame, out: str = "ordinal", key: str = "video_id") -> DataFrame:
    """Words ``(key, segment_id, i)`` numbered 0, 1, ... along their recording in ``out``."""
    chunk = nested_chunk(F.col("segment_id"), F.col("i"), WORD_CHUNK)
    numbered = ordered_scan(words, [key], ["segment_id", "i"], chunk, position="__pos")
    return numbered.withColumn(out, F.col("__pos") - 1).drop("__pos")


def number_words(words: DataFrame) -> DataFrame:
    """Words of a scene numbered 0, 1, ... in ``w``, with their ``tokens``.

    ``p`` counts the tokens of the scene before the word, ``prior`` is the last.
    """
    whole, cut = F.col("__whole"), F.col("__cut")
    # Most words are one token and travel as it; only others are cut.
    parts = _tokens(F.col("word"))
    plain = F.col("word").rlike(_WHOLE)
    kept = words.where(F.col("global_scene_id").isNotNull()).select(
        *SCENE, "segment_id", "i", "start", "end", "probability", F.when(plain, F.col("word")).alias("__whole"), F.when(~plain, parts).alias("__cut")
    )
    return ordered_scan(
        kept,
        SCENE,
        ["segment_id", "i"],
        nested_chunk(F.col("segment_id"), F.col("i"), WORD_CHUNK),
        position="__pos",
        sums={"p": F.when(whole.isNotNull(), 1).otherwise(F.size(cut)).cast("long")},
        prior={"prior": F.coalesce(whole, F.try_element_at(cut, F.lit(-1)))},
    ).withColumns({"w": F.col("__pos") - 1, "tokens": F.when(whole.isNotNull(), F.array(whole)).otherwise(cut)}).drop("__pos", "__whole", "__cut")


#: A word that is its own token: nothing to part, no dots to replace.
_WHOLE = r"^[A-Za-zÀ-ÿЀ-ӿ0-9',;:-]+[.!?]?$"


def _tokens(word: Column) -> Column:
    spaced = F.regexp_replace(word, rf"([.!?…])({CAPITAL})", "$1 $2")
    dots = F.regexp_replace(F.replace(spaced, F.lit("…"), F.lit("...")), r"\.{3,}", "...")
    return split_words(dots)


def sentence_tokens(numbered: DataFrame) -> DataFrame:
    """Tokens ``(scene, sid, p, start, clause, token)`` of all sentences.

    ``p`` is the token's place in the scene, ``start`` that of its sentence;
    ``clause`` counts clause marks along the scene.
    """
    tokens = numbered.select(*SCENE, "p", "prior", "tokens", F.posexplode("tokens").alias("k", "token")).select(
        *SCENE,
        (F.col("p") + F.col("k")).alias("p"),
        "token",
        F.when(F.col("k") == 0, F.col("prior")).otherwise(F.get("tokens", F.col("k") - 1)).alias("__prev"),
    )
    opens = F.col("__prev").rlike(r"[.!?…]$") & F.col("token").rlike(f"^{CAPITAL}")
    flagged = tokens.withColumn("__opens", F.coalesce(opens, F.lit(False)).cast("long")).withColumn(
        "__mark", F.coalesce(F.col("__prev").rlike("[,;—]$"), F.lit(False)).cast("long")
    )
    placed = ordered_scan(
        flagged.drop("__prev"),
        SCENE,
        ["p"],
        chunk_of(F.col("p"), WORD_CHUNK),
        sums={"__s": F.col("__opens"), "__c": F.col("__mark")},
        carry={"__start": F.when(F.col("__opens") == 1, F.col("p"))},
    )
    return placed.select(
        *SCENE,
        (F.col("__s") + F.col("__opens")).alias("sid"),
        "p",
        F.coalesce("__start", F.lit(0)).cast("long").alias("start"),
        (F.col("__c") + F.col("__mark")).alias("clause"),
        "token",
    )


def _joined(tokens: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(tokens), lambda x: x["token"]), " ")


def _pack_clauses(tokens: DataFrame, max_words: int) -> DataFrame:
    """Tokens ``(scene, sid, __at, __clause)`` of long sentences with the ``part`` they fall into."""
    keys = [*SCENE, "sid"]
    clauses = tokens.groupBy(*keys, "__clause").agg(F.min("__at").alias("__from"), (F.max("__at") + 1).alias("__to"))
    packed = follow(clauses, keys, "__clause", Extent("__from", "__to", float(max_words)), "__opener", ["__from"])
    bases = packed.where("__clause = __opener").select(*keys, "__opener", F.col("__from").alias("__base"))
    based = packed.join(bases, [*keys, "__opener"]).select(*keys, "__clause", "__base")
    within = F.col("__at") - F.col("__base")
    part = (F.col("__base") + F.floor(within / max_words) * max_words).cast("long")
    return tokens.join(based, [*keys, "__clause"]).withColumn("part", part).drop("__clause", "__base")


def split_long(tokens: DataFrame, max_words: int) -> DataFrame:
    """``part`` for tokens ``(scene, sid, p, token, n)`` of sentences of ``n`` tokens.

    Sentences over ``max_words`` are broken as in ``split_sentences``; the others are part 0.
    """
    keys = [*SCENE, "sid"]
    long = tokens.where(F.col("n") > max_words)
    chunk = chunk_of(F.col("p"), WORD_CHUNK)
    seen = ordered_scan(long, keys, ["p"], chunk, position="__pos", lags={"__prev": F.col("token")})
    marked = seen.withColumn("__mark", F.coalesce(F.col("__prev").rlike("[,;—]$"), F.lit(False)).cast("long"))
    placed = ordered_scan(marked, keys, ["p"], chunk, sums={"__c": F.col("__mark")})
    placed = placed.select(
        *keys, "p", "token", "n", (F.col("__pos") - 1).alias("__at"), (F.col("__c") + F.col("__mark")).alias("__clause")
    )
    short = tokens.where(F.col("n") <= max_words).withColumn("part", F.lit(0).cast("long"))
    broken = _pack_clauses(materialize(placed, "clauses"), max_words).drop("__at")
    return short.select(*broken.columns).unionByName(broken)


def split_sentences(tokens: DataFrame, max_words: int) -> DataFrame:
    """Sentences ``(scene, sid, part, p, n_tokens, sentence)`` of at most ``max_words`` tokens.

    A sentence counts if it has two tokens and one word character; a scene
    without any is one sentence, number 0. Longer ones are broken at clause
    marks, clauses packed greedily; a clause that is too long on its own is cut
    every ``max_words`` tokens. ``part`` is the offset of a part, 0 for the first.
    """
    sizes = tokens.groupBy(*SCENE, "sid").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.max(F.col("token").rlike(r"(?U)\w")).alias("__worded"),
        F.min("p").alias("p"),
        F.min("clause").alias("__clause_0"),
        # The first max_words tokens, which is all of a sentence that isn't broken.
        F.collect_list(F.when(F.col("p") - F.col("start") < max_words, F.struct("p", "token"))).alias("__first"),
    )
    sizes = sizes.withColumn("__good", (F.col("n_tokens") >= 2) & F.col("__worded"))
    sizes = materialize(sizes, "sentence-sizes")
    usable = sizes.groupBy(*SCENE).agg(F.max("__good").alias("__any"))
    short = sizes.where(F.col("__good") & (F.col("n_tokens") <= max_words)).select(
        *SCENE, "sid", F.lit(0).cast("long").alias("part"), "p", "n_tokens", _joined(F.col("__first")).alias("sentence")
    )
    keys = [*SCENE, "sid"]
    broken = sizes.where(F.col("__good") & (F.col("n_tokens") > max_words)).select(*keys, F.col("p").alias("__p0"), "__clause_0")
    zero = F.lit(0).cast("long")
    parts = tokens.join(broken, keys).select(*keys, "p", "__p0", "__clause_0", "clause", "token")
    whole = tokens.join(usable.where(~F.col("__any")).select(*SCENE), SCENE).select(
        *SCENE, zero.alias("sid"), "p", zero.alias("__p0"), zero.alias("__clause_0"), "clause", "token"
    )
    long = parts.unionByName(whole).select(
        *keys, "p", "token", (F.col("p") - F.col("__p0")).alias("__at"), (F.col("clause") - F.col("__clause_0")).alias("__clause")
    )
    broken_up = _pack_clauses(long, max_words)
    return short.unionByName(
        broken_up.groupBy(*keys, "part").agg(
            F.min("p").alias("p"),
            F.count(F.lit(1)).alias("n_tokens"),
            _joined(F.collect_list(F.struct("p", "token"))).alias("sentence"),
        )
    )


def timed_sentences(numbered: DataFrame, max_words: int) -> DataFrame:
    """Sentences in order with text, tokens, times and confidence.

    A sentence of n tokens takes the next n words of the scene. Dropped
    one-word sentences do not use up their words, so later sentences shift.
    """
    tokens = materialize(sentence_tokens(numbered), "sentence-tokens")
    sentences = materialize(split_sentences(tokens, max_words), "sentences")
    ordered = ordered_scan(
        sentences, SCENE, ["p"], chunk_of(F.col("p"), WORD_CHUNK), position="__pos", sums={"__from": F.col("n_tokens")}
    )
    # Words and the sentences' first places in one scan; a sentence is told to every chunk that holds words of it.
    chunk = chunk_of(F.col("__from"), WORD_CHUNK)
    last = chunk_of(F.col("__from") + F.col("n_tokens") - 1, WORD_CHUNK)
    told = ordered.select("*", F.explode(F.sequence(chunk, last)).alias("__c"))
    opening = told.select(
        *SCENE,
        "__c",
        F.greatest("__from", F.col("__c") * WORD_CHUNK).alias("w"),
        F.struct((F.col("__pos") - 1).alias("s"), (F.col("__from") + F.col("n_tokens")).alias("to")).alias("__in"),
        F.when(F.col("__c") == chunk, F.col("sentence")).alias("sentence"),
        "n_tokens",
    )
    spoken = numbered.select(*SCENE, chunk_of(F.col("w"), WORD_CHUNK).alias("__c"), "w", "start", "end", "probability", F.col("w").alias("__w"))
    order = Window.partitionBy(*SCENE, "__c").orderBy("w", F.col("__w").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = opening.unionByName(spoken, allowMissingColumns=True).withColumn("__in", F.last("__in", ignorenulls=True).over(order))
    return (
        both.where("w < __in.to")
        .groupBy(*SCENE, F.col("__in.s").alias("s"))
        .agg(
            F.max("sentence").alias("sentence"),
            F.max("n_tokens").alias("n_tokens"),
            F.min_by("start", "__w").alias("start"),
            F.max_by("end", "__w").alias("end"),
            F.count("__w").alias("n_words"),
            F.sum("probability").alias("confidence_sum"),
        )
        .where("n_words > 0")
    )


def _successor(limits: Limits) -> Column:
    """Offset at which the next segment starts, from the few sentences ahead."""
    state = F.struct(
        F.lit(0).cast("long").alias("words"), F.lit(None).cast("int").alias("stop")
    )

    def step(acc: Column, x: Column) -> Column:
        words, n, k = acc["words"], x["n"], x["off"]
        topic = (
            (words >= limits.min_words)
            & (words >= limits.target_words)
            & (x["sim"] < limits.min_similarity)
        )
        full = (words + n > limits.max_words) | (k + 1 > limits.max_sentences)
        stop = F.when(acc["stop"].isNotNull(), acc["stop"]).when((k > 0) & (full | topic), k)
        return F.struct((words + n).alias("words"), stop.alias("stop"))

    return F.aggregate(F.array_sort("__ahead"), state, step)["stop"]


def pack_sentences(sentences: DataFrame, limits: Limits, vector: str | None = None) -> DataFrame:
    """Sentences with ``seg``, the index of the sentence that opens their segment.

    Neighbouring sentences are compared by the cosine of their vectors where
    ``vector`` names a column and both have one, else by their shared words.
    """
    payload = [c for c in sentences.columns if c not in (*SCENE, "s")]
    # Chunks with the sentence before them and those that a segment may reach; bags are made after the shuffle.
    chunk, place = chunk_of(F.col("s"), WORD_CHUNK), F.col("s") % WORD_CHUNK
    reached = F.array(
        chunk,
        F.when((place < limits.max_sentences) & (chunk > 0), chunk - 1),
        F.when(place == WORD_CHUNK - 1, chunk + 1),
    )
    dealt = sentences.withColumn("__c", F.explode(F.array_compact(reached))).repartition(*SCENE, "__c")
    along = Window.partitionBy(*SCENE, "__c").orderBy("s")
    own = F.struct("s", overlap_words(F.col("sentence")).alias("bag"), *([F.col(vector).alias("v")] if vector else []))
    seen = dealt.withColumn("__it", own).withColumn("__before", F.lag("__it").over(along))
    alike = jaccard(F.col("__before.bag"), F.col("__it.bag"))
    if vector:
        alike = F.coalesce(cosine(F.col("__before.v"), F.col("__it.v")), alike)
    alike = F.when(F.col("__before.s") == F.col("s") - 1, alike)
    ahead = F.struct("s", F.col("n_tokens").alias("n"), F.coalesce(alike, F.lit(0.0)).alias("sim"))
    found = seen.withColumn("__one", ahead).withColumn("__ahead", F.collect_list("__one").over(along.rangeBetween(0, limits.max_sentences)))
    offsets = F.transform("__ahead", lambda x: F.struct((x["s"] - F.col("s")).cast("int").alias("off"), x["n"].alias("n"), x["sim"].alias("sim")))
    kept = found.where(F.col("__c") == chunk).withColumn("__ahead", offsets)
    linked = kept.select(*SCENE, "s", *payload, (F.col("s") + _successor(limits)).alias("__next"))
    return follow(linked, SCENE, "s", "__next", "seg", payload)


def local_segments(
    words: DataFrame,
    scenes: DataFrame,
    limits: Limits = Limits(),
    embed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Segments of every scene, numbered per recording.

    ``embed`` adds a column ``vector`` to the timed sentences, from a model of
    the caller's; without it sentences are compared by their words.
    ``words`` carry ``global_scene_id``. A short last segment joins the one
    before it and keeps that one's confidence; a scene without words becomes a
    silent segment.
    """
    numbered = materialize(number_words(words), "scene-words")
    sentences = materialize(timed_sentences(numbered, limits.max_words), "timed-sentences")
    if embed is not None:
        sentences = materialize(embed(sentences), "sentence-vectors")
    packed = pack_sentences(sentences, limits, "vector" if embed else None)
    # A segment holds at most max_sentences sentences.
    segments = packed.groupBy(*SCENE, "seg").agg(
        F.min("start").alias("__start"),
        F.max_by("end", "s").alias("__end"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("s", "sentence"))), lambda x: x["sentence"]
            ),
            " ",
        ).alias("text"),
        F.count(F.lit(1)).alias("sentence_count"),
        F.sum("n_words").alias("word_count"),
        F.sum("n_tokens").alias("__tokens"),
        (F.sum("confidence_sum") / F.sum("n_words")).alias("__mean"),
    )
    segments = materialize(segments.withColumn("start", F.bround("__start", 2)), "segments")
    # A segment's sentences are consecutive, so the one before the last ends where that begins.
    last = segments.groupBy(*SCENE).agg(
        F.max("seg").alias("__last"),
        F.max_by(F.struct("text", "__end", "__tokens", "sentence_count"), "seg").alias("__n"),
        F.count(F.lit(1)).alias("__of"),
    )
    joins = (F.col("__n.__tokens") < limits.min_words) & (F.col("__of") > 1)
    marked = segments.join(last, SCENE).where(~(joins & (F.col("seg") == F.col("__last"))))
    takes = joins & (F.col("seg") + F.col("sentence_count") == F.col("__last"))
    # Sums differ in their last bits with the order of rows; a tie must not hang on that.
    mean = F.bround(F.round("__mean", 12), 3)
    spoken = marked.select(
        *SCENE,
        "seg",
        "start",
        F.when(takes, F.col("__n.__end")).otherwise(F.bround("__end", 2)).alias("end"),
        F.when(takes, F.col("__n.__end") - F.col("start"))
        .otherwise(F.bround(F.col("__end") - F.col("__start"), 2))
        .alias("duration"),
        F.when(takes, F.concat_ws(" ", "text", "__n.text")).otherwise(F.col("text")).alias("text"),
        (F.col("sentence_count") + F.when(takes, F.col("__n.sentence_count")).otherwise(0)).alias(
            "sentence_count"
        ),
        (F.col("word_count") + F.when(takes, F.col("__n.__tokens")).otherwise(0)).alias(
            "word_count"
        ),
        F.lit(True).alias("has_speech"),
        F.when(F.col("__mean") != 0, mean).alias("confidence_average"),
    )
    counts = numbered.groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("__words"), F.avg("probability").alias("__mean")
    )
    rest = scenes.join(last.select(*SCENE), SCENE, "left_anti").join(counts, SCENE, "left")
    has_words = F.col("__words").isNotNull()
    silent = rest.select(
        *SCENE,
        F.lit(0).cast("long").alias("seg"),
        "start",
        "end",
        (F.col("end") - F.col("start")).alias("duration"),
        F.when(has_words, F.repeat(F.lit(" "), (F.col("__words") - 1).cast("int")))
        .otherwise("")
        .alias("text"),
        F.lit(0).cast("long").alias("sentence_count"),
        F.coalesce("__words", F.lit(0)).cast("long").alias("word_count"),
        has_words.alias("has_speech"),
        F.col("__mean").alias("confidence_average"),
    )
    return ordered_scan(
        materialize(spoken.unionByName(silent), "scene-segments"),
        ["video_id"],
        ["global_scene_id", "seg"],
        nested_chunk(F.col("global_scene_id"), F.col("seg"), WORD_CHUNK),
        position="__pos",
    ).select(
        "video_id",
        (F.col("__pos") - 1).alias("local_segment_id"),
        "global_scene_id",
        "start",
        "end",
        "duration",
        "text",
        "sentence_count",
        "word_count",
        "has_speech",
        "confidence_average",
    )


def segment_statistics(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """Word-count and sentence-count buckets, means, medians and totals."""
    n, s = F.col("word_count"), F.col("sentence_count")
    spoken = F.col("has_speech")
    buckets = {
        "words_under_8": n < 8,
        "words_8_25": (n >= 8) & (n < 25),
        "words_25_40": (n >= 25) & (n < 40),
        "words_40_60": (n >= 40) & (n <= 60),
        "words_over_60": n > 60,
        **{f"sentences_{k}": s == k for k in range(1, 6)},
        "sentences_over_5": s > 5,
    }
    plain = segments.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(spoken).alias("segments_with_speech"),
        F.sum(n).alias("total_words"),
        *[F.count_if(spoken & cond).alias(name) for name, cond in buckets.items()],
        F.avg(F.when(spoken, n)).alias("average_words"),
        F.avg(F.when(spoken, s)).alias("average_sentences"),
    )
    middle = exact_quantiles(segments.where(spoken), [key], "word_count", {"median_words": 0.5})
    return plain.join(middle, key, "left")
