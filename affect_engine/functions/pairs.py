"""Cleaning of parallel text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab
from .text import SPACE


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which Spark has no function for."""
    for texts in batches:
        yield texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def clean_pair_text(text: Column, lang: str) -> Column:
    """Compose, drop invisible characters, unify quotes, dashes and symbols.

    English text also has its Cyrillic look-alikes replaced.
    """
    text = F.coalesce(text, F.lit(""))
    text = nfkc(text)
    text = F.regexp_replace(text, r"[\x{200b}-\x{200f}\x{feff}]", "")
    text = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    if lang == "en":
        text = F.translate(text, "".join(vocab.HOMOGLYPHS), "".join(vocab.HOMOGLYPHS.values()))
    text = F.regexp_replace(text, '["„‟]', '"')
    text = F.regexp_replace(text, "‚", "'")
    text = F.regexp_replace(text, "[—–]", "-")
    text = F.regexp_replace(text, SPACE + "+", " ")
    for symbol, name in vocab.SYMBOL_NAMES.items():
        text = F.replace(text, F.lit(symbol), F.lit(name))
    return F.btrim(text)
