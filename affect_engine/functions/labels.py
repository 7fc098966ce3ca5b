"""Emotion labels as Columns: canonical class, display name, ids, annotations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import EMOTION_ALIASES, EMOTION_CLASSES, EMOTION_DISPLAY, LABEL_PRIORITY


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


_CANONICAL = {**{c: c for c in EMOTION_CLASSES}, **EMOTION_ALIASES}


def canonical_or_null(label: Column) -> Column:
    return literal_map(_CANONICAL)[F.lower(F.trim(label))]


def canonicalize(label: Column, default: Column | None = None, strict: bool = False) -> Column:
    """Canonical class; unknown labels become ``default`` or raise when strict."""
    known = canonical_or_null(label)
    if strict:
        failure = F.raise_error(F.concat(F.lit("unrecognised emotion label "), label))
        return F.when(known.isNotNull(), known).otherwise(failure)
    return F.coalesce(known, F.lit(None).cast("string") if default is None else default)


def vote_label(label: Column) -> Column:
    """Canonical class, or the trimmed lower-cased label itself when unknown."""
    return canonicalize(label, default=F.lower(F.trim(label)))


def timeline_label(label: Column) -> Column:
    """Struct of label and whether it was recognised; unknown counts as neutral."""
    known = literal_map(_CANONICAL)[F.lower(label)]
    return F.struct(
        F.coalesce(known, F.lit("neutral")).alias("label"),
        known.isNotNull().alias("is_known"),
    )


def capitalize(text: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(_rest(text)))


def _rest(text: Column) -> Column:
    return F.substring(text, F.lit(2), F.greatest(F.length(text), F.lit(1)))


def display(label: Column) -> Column:
    """Name shown to readers; an unknown label is capitalised, not lost."""
    return F.coalesce(literal_map(EMOTION_DISPLAY)[canonical_or_null(label)], capitalize(label))


def label_id(label: Column, classes=EMOTION_CLASSES, strict: bool = True) -> Column:
    """0-based id in the sorted class list; an unknown label is an error."""
    position = F.array_position(F.array(*[F.lit(c) for c in sorted(classes)]), F.lower(label))
    found = F.when(position > 0, (position - 1).cast("int"))
    if not strict:
        return found
    failure = F.raise_error(F.concat(F.lit("label outside the class list: "), label))
    return F.when(position > 0, found).otherwise(failure.cast("int"))


def parse_annotations(text: Column) -> Column:
    """``['a', 'b']`` as an array of lower-case names; malformed text gives []."""
    element = "(?:'[^']*'|\"[^\"]*\")"
    shape = rf"^\s*[\[(]\s*(?:{element}\s*(?:,\s*{element}\s*)*,?)?\s*[\])]\s*$"
    names = F.regexp_extract_all(F.lower(text), F.lit("['\"]([^'\"]*)['\"]"), 1)
    return F.when(text.rlike(shape), names).otherwise(F.array().cast("array<string>"))


def collapse_by_priority(labels: Column) -> Column:
    """First class of the fixed priority list present in an array of names."""
    order = F.array(*[F.lit(c) for c in LABEL_PRIORITY])
    return F.get(F.filter(order, lambda c: F.array_contains(labels, c)), F.lit(0))
