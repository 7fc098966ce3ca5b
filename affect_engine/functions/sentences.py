"""Sentences and similarity, as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_whitespace, let, words
from .vocab import OVERLAP_STOPWORDS

CAPITAL = "[А-ЯA-ZЁ«]"


def split_sentences(text: Column) -> Column:
    """Sentences with their punctuation; one-word and wordless pieces dropped."""
    text = collapse_whitespace(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, rf"([.!?…])({CAPITAL})", "$1 $2")
    text = F.regexp_replace(F.replace(text, F.lit("…"), F.lit("...")), r"\.{3,}", "...")
    parts = F.split(text, rf"(?<=[.!?…])\s+(?={CAPITAL})")
    return F.filter(
        F.transform(parts, lambda s: F.btrim(s)),
        lambda s: (F.size(words(s)) >= 2) & s.rlike(r"(?U)\w"),
    )


def overlap_words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more, stopwords removed."""
    stop = F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS])
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    return F.array_distinct(
        F.filter(bare, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct values, 0 when one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        let(shared, lambda s: s.cast("double") / (F.size(a) + F.size(b) - s))
    )


def word_overlap(a: Column, b: Column) -> Column:
    return let(
        F.struct(overlap_words(a).alias("a"), overlap_words(b).alias("b")),
        lambda x: jaccard(x["a"], x["b"]),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, v: s + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, never below 0; null when either has no length."""
    return F.greatest(F.lit(0.0), F.try_divide(dot(a, b), norm(a) * norm(b)))


def similarity(text_a: Column, text_b: Column, vec_a=None, vec_b=None) -> Column:
    """Cosine where both vectors exist, word overlap elsewhere."""
    fallback = word_overlap(text_a, text_b)
    if vec_a is None or vec_b is None:
        return fallback
    return F.coalesce(cosine(vec_a, vec_b), fallback)
