"""The text normaliser, as native Columns.

Twelve steps in a fixed order, in three phases: ``clean_early`` before
deduplication, ``clean_late`` after it and ``tidy`` after the length filter.
No step leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .labels import literal_map

# Whitespace as Python's str.split and \s see it; spelled out so that Java and
# RE2 agree.
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Pictograph ranges and ASCII emoticons.
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]+"
)
EMOTICONS = (
    r":-?\)|:-?\(|:-?[DPOp]|:-?/|:-?\||;-?\)|</?3|[xX]D|>:-?\(|D:|:-?\*|:\^"
    r"|=[)DP/]|8-?\)|B-?\)|[oO]_[oO]|\^_?\^|-_-|T_T|TT|><"
)

WORD_EDGE = ".,!?;:\"'"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, collapsed: bool = False) -> Column:
    """Array of whitespace-separated words; ``collapsed`` text has single blanks only."""
    return F.filter(F.split(text, " " if collapsed else SPACE + "+"), lambda w: w != "")


def _rejoin(array: Column) -> Column:
    return F.array_join(array, " ")


def _is_placeholder(word: Column) -> Column:
    return word.startswith("[") & word.endswith("]")


def normalize_quotes(text: Column) -> Column:
    fancy, plain = "".join(vocab.QUOTES), "".join(vocab.QUOTES.values())
    return F.translate(text, fancy, plain)


def normalize_placeholders(text: Column) -> Column:
    def rewrite(t: Column) -> Column:
        for canonical, spellings in vocab.PLACEHOLDERS.items():
            t = F.regexp_replace(t, rf"(?iu)\[(?:{'|'.join(spellings)})\]", f"[{canonical}]")
        return t

    return let(text, lambda t: F.when(F.contains(t, F.lit("[")), rewrite(t)).otherwise(t))


def strip_emoji(text: Column) -> Column:
    # The look-ahead names every first character, so most positions fail at once.
    return F.regexp_replace(
        F.regexp_replace(text, EMOJI, ""), rf"(?=[:;<xXD>=8BoO^T-])(?:{EMOTICONS})", ""
    )


def _slang_lookup(key: Column) -> Column:
    # Two small maps in a row: first the initial, then the few words under it.
    by_initial: dict[str, dict[str, str]] = {}
    for short, long in vocab.SLANG.items():
        by_initial.setdefault(short[0], {})[short] = long
    nested = []
    for initial, entries in by_initial.items():
        nested += [F.lit(initial), literal_map(entries)]
    longest = max(map(len, vocab.SLANG))
    return F.when(
        F.length(key) <= longest, F.create_map(*nested)[F.substring(key, 1, 1)][key]
    )


def expand_slang(text: Column, collapsed: bool = False) -> Column:
    def expand(word: Column) -> Column:
        key = F.btrim(F.lower(word), F.lit(WORD_EDGE))
        return F.coalesce(let(key, _slang_lookup), word)

    return _rejoin(F.transform(words(text, collapsed), expand))


def mask_entities(text: Column) -> Column:
    def either(entries, both_cases: bool = False) -> str:
        # First letters ahead of the boundary test: it is the dearer of the two.
        initials = {e[0] for e in entries}
        if both_cases:
            initials |= {x for c in initials for x in (c.lower(), c.upper())}
        return rf"(?=[{''.join(sorted(initials))}])\b(?:{'|'.join(entries)})\b"

    for pattern, marker in (
        (rf"https?://{_NOT_SPACE}+|www\.{_NOT_SPACE}+", "[URL]"),
        (r"(?U)@\w+", "[TAG]"),
        (r"(?U)#\w+", "[TAG]"),
        (r"(?U)(?=\d)\b\d+\.?\d*\b", "[NUM]"),
        (f"(?U){either(vocab.NAMES)}", "[NAME]"),
        (f"(?iU){either(vocab.RELIGIONS, both_cases=True)}", "[RELIGION]"),
        (f"(?U){either(vocab.CITIES)}", "[CITY]"),
    ):
        text = F.regexp_replace(text, pattern, marker)
    return text


_NOT_SPACE = "[^" + SPACE[1:]


def collapse_whitespace(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACE + "+", " "))


def is_shouted(word: Column) -> Column:
    return let(
        F.btrim(word, F.lit(".,!?;:'\"")),
        lambda bare: (F.upper(bare) == bare)
        & (F.lower(bare) != bare)
        & bare.rlike(r"^\p{L}{2,}$"),
    )


def mark_shouting(text: Column, collapsed: bool = False) -> Column:
    def mark(word: Column) -> Column:
        # Most words are lower-case already and need no further look.
        return let(
            F.lower(word),
            lambda lowered: F.when((lowered == word) | _is_placeholder(word), word)
            .when(is_shouted(word), F.concat(F.lit("[CAPS] "), lowered))
            .otherwise(lowered),
        )

    return _rejoin(F.transform(words(text, collapsed), mark))


def normalize_punctuation(text: Column) -> Column:
    text = F.regexp_replace(text, r"!{2,}", "!!")
    text = F.regexp_replace(text, r"\?{2,}", "??")

    def settle(piece: Column) -> Column:
        bangs = F.length(F.regexp_replace(piece, r"[^!]", ""))
        marks = F.length(F.regexp_replace(piece, r"[^?]", ""))
        return F.when(
            piece.rlike(r"^[?!]{3,}$"), F.when(bangs > marks, F.lit("!!")).otherwise(F.lit("??"))
        ).otherwise(piece)

    def mixed(whole: Column) -> Column:
        pieces = F.regexp_extract_all(whole, F.lit(r"[?!]{3,}|[?!]{1,2}|[^?!]+"), 0)
        return F.array_join(F.transform(pieces, settle), "")

    text = let(text, lambda t: F.when(t.rlike(r"[?!]{3,}"), mixed(t)).otherwise(t))
    text = F.regexp_replace(text, r"\.{4,}", "...")
    text = F.regexp_replace(text, r",{2,}", ",")
    return F.regexp_replace(text, SPACE + r"+([.,!?;:])", "$1")


def squeeze_repeats(text: Column, collapsed: bool = False) -> Column:
    def squeeze(word: Column) -> Column:
        return F.when(_is_placeholder(word), word).otherwise(
            F.regexp_replace(word, r"(.)\1{2,}", "$1$1")
        )

    return let(
        text,
        lambda t: F.when(
            t.rlike(r"(.)\1{2}"), _rejoin(F.transform(words(t, collapsed), squeeze))
        ).otherwise(t if collapsed else _rejoin(words(t))),
    )


def drop_repeated_placeholders(text: Column, collapsed: bool = False) -> Column:
    def kept(tokens: Column) -> Column:
        return F.filter(
            tokens,
            lambda w, i: ~(_is_placeholder(w) & (i > 0) & (w == F.get(tokens, i - 1))),
        )

    return _rejoin(let(words(text, collapsed), kept))


BEFORE_DEDUPE = (
    normalize_quotes,
    normalize_placeholders,
    strip_emoji,
    expand_slang,
    mask_entities,
    collapse_whitespace,
)
AFTER_DEDUPE = (mark_shouting, collapse_whitespace, normalize_punctuation, squeeze_repeats)
FINALLY = (drop_repeated_placeholders, collapse_whitespace)
PIPELINE = BEFORE_DEDUPE + AFTER_DEDUPE + FINALLY


# Steps that leave single blanks between words, and steps that keep them so.
_COLLAPSING = (
    expand_slang,
    collapse_whitespace,
    mark_shouting,
    squeeze_repeats,
    drop_repeated_placeholders,
)
_KEEPING = (mask_entities, normalize_punctuation)


def _chain(text: Column, steps) -> Column:
    """Apply the steps in order, leaving out whitespace work already done."""
    collapsed = False
    for step in steps:
        if step is collapse_whitespace:
            text = text if collapsed else step(text)
        elif step in _COLLAPSING:
            text = step(text, collapsed)
        else:
            text = step(text)
        collapsed = step in _COLLAPSING or (collapsed and step in _KEEPING)
    return text


def clean_early(text: Column) -> Column:
    return _chain(text, BEFORE_DEDUPE)


def clean_late(text: Column) -> Column:
    return _chain(text, AFTER_DEDUPE)


def tidy(text: Column) -> Column:
    return _chain(text, FINALLY)


def clean_text(text: Column) -> Column:
    return _chain(text, PIPELINE)


TRANSFORMS = {"clean_text": clean_text, "clean_early": clean_early, None: lambda c: c}


def transform_for(name: str | None):
    """The text transform a model asks for; an unknown name is an error."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown text transform {name!r}")
    return TRANSFORMS[name]


# --- simpler cleaners used by the baseline features --------------------------


def clean_baseline(text: Column) -> Column:
    """Lower-case, collapse space, keep word characters and ``! ? .``."""
    text = collapse_whitespace(F.lower(F.coalesce(text, F.lit(""))))
    text = F.regexp_replace(text, r"(?U)[^\w\s!?.]", " ")
    text = F.regexp_replace(text, r"!{2,}", "!!")
    text = F.regexp_replace(text, r"\?{2,}", "??")
    return F.btrim(text, F.lit(" \t\r\n"))


def clean_cyrillic(text: Column) -> Column:
    """Lower-case Cyrillic words of two letters or more."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^а-яё\s]", " ")
    return _rejoin(F.filter(words(kept), lambda w: F.length(w) >= 2))


def clean_for_lemmas(text: Column) -> Column:
    """Drop punctuation but hyphens, then digits; collapse; lower-case."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s\-]", " ")
    text = F.regexp_replace(text, r"(?U)\d+", "")
    return F.lower(collapse_whitespace(text))


def emotion_tokens(text: Column) -> Column:
    """Words of the lower-cased text; exclamation and question marks become tokens."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for pattern, token in (
        (r"!{2,}", " EXCLAMATION_MULTIPLE "),
        (r"\?{2,}", " QUESTION_MULTIPLE "),
        (r"!", " EXCLAMATION "),
        (r"\?", " QUESTION "),
    ):
        text = F.regexp_replace(text, pattern, token)
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), 0)


def fixed_length(ids: Column, length: int) -> Column:
    """Cut or zero-pad an id array to ``length``."""
    padded = F.concat(ids, F.array_repeat(F.lit(0).cast("int"), length))
    return F.slice(padded, 1, length)


def text_counters(text: Column) -> dict[str, Column]:
    chars = F.length(text)
    return {
        "n_chars": chars,
        "n_words": F.size(words(text)),
        "n_exclamation": F.regexp_count(text, F.lit("!")),
        "n_question": F.regexp_count(text, F.lit(r"\?")),
        "capital_ratio": F.try_divide(F.regexp_count(text, F.lit("[A-Z]")), chars),
    }
