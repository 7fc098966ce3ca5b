"""Cleaning a table gives what the steps give on whole texts, and hands them few words."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affect_engine.functions import text, vocab
from affect_engine.operators.cleaning import clean_texts, stretches

WORDS = [
    "house", "House", "HOUSE", "été,", "дом.", "Дом", "ДОМ!", "soooo", "the", "I", "x", "New", "York", "york,", "Los", "Angeles",
    "hindu", "Hindu", "HINDU", "[TAG]", "[tag]", "[RELIGION]", "@you", "#a", "www.", "www.a.b", "https://x", "12.5", "b4", "omg", "OMG!!",
    ".", ",", "?!?!", "!!", ":-)", "xD", "TT", "TT.", "D:", "o_o", "“a”", "‚", "\U0001f600", "\U0001f600.", "ok....", "a,,", "–", "...b", "?", "ſ", "İ",
    "ab***", "A$$$", "De,&&&&", "x:***", "xwww.***", "www.***", "a###b", "Trump%%%", "y.***", "aaa", "D", "D!", "Ж", "bb:",
    *vocab.NAMES[:3], *list(vocab.SLANG)[:6],
]
GAPS = [" ", " ", " ", "  ", "\n", "\t", "\x1c", " ", "   ", ""]


@pytest.mark.parametrize("clean", [text.clean_early, text.clean_text])
def test_equals_the_steps_on_whole_texts(spark, clean):
    rng = random.Random(5)
    texts = ["".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(30))) for _ in range(1500)]
    rows = [(i, x, [i]) for i, x in enumerate([None, "", " \n", *texts])]
    df = spark.createDataFrame(rows, "i int, x string, other array<int>")
    got = {r.i: r.x for r in clean_texts(df, "x", clean).collect()}
    want = {r.i: r.x for r in df.select("i", clean(F.col("x")).alias("x")).collect()}
    assert got == want
    assert clean_texts(df, "x", clean).schema == df.schema


def test_plain_words_are_not_handed_to_the_steps():
    found = stretches(pa.array(["a house, in the Été of дом . and so on", None, "", "x"])).to_pylist()
    assert [(r["s"], r["plain"]) for r in found[0]] == [("a house, in the Été of", True), ("дом .", False), ("and so on", True)]
    assert found[1] is None and found[2] == [] and found[3] == [{"s": "x", "plain": True}]
