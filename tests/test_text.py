import pytest
from pyspark.sql import functions as F

from affect_engine.functions import labels, sentences, text
from affect_engine.functions.pairs import clean_pair_text

GOLDEN = {
    "Check https://example.com now": "check https/example.com now",
    "That was AMAZING": "that was [CAPS] amazing",
    "That was OMG": "that was oh my god",
    "The goat climbed the roof": "the greatest of all time climbed the roof",
    "Waiting for the sub": "waiting for the subscribe",
    "ЭТО ВАЖНО, @Иван!!!!": "[CAPS] это [CAPS] важно, [tag]!!",
    "soooo good": "soo good",
    "b4 the 24/7 shop": "before the twenty four seven shop",
    "": "",
}


def test_clean_text_golden(one):
    assert one(text.clean_text, list(GOLDEN)) == list(GOLDEN.values())


def test_order_of_steps_is_fixed():
    assert [s.__name__ for s in text.PIPELINE] == [
        "normalize_quotes",
        "normalize_placeholders",
        "strip_emoji",
        "expand_slang",
        "mask_entities",
        "collapse_whitespace",
        "mark_shouting",
        "collapse_whitespace",
        "normalize_punctuation",
        "squeeze_repeats",
        "drop_repeated_placeholders",
        "collapse_whitespace",
    ]


def test_leaving_out_whitespace_work_changes_nothing(one):
    samples = [
        "  a \t b\n\nc ",
        "Wow  :-)  !  JOHN   met  [tag] [TAG] [TAG]  in  London ...",
        "«Да»  –  НЕТ ?!?!  хаааа www.x.ru  12.5kg",
        "[NAME] [NAME] \x1c z \U0001f600 !!!? ...... ,,",
    ]

    def stepwise(c):
        for step in text.PIPELINE:
            c = step(c)
        return c

    assert one(text.clean_text, samples) == one(stepwise, samples)


def test_placeholders_cyrillic_and_numbers(one):
    assert one(text.normalize_placeholders, ["[имени] [Org] [место]"]) == ["[NAME] [ORGANIZATION] [LOCATION]"]
    assert one(text.mask_entities, ["call 12.5 or x12 Trump's christian @я www.a.b"]) == [
        "call [NUM] or x12 [NAME]'s [RELIGION] [TAG] [URL]"
    ]


def test_mixed_marks_are_counted(one):
    assert one(text.normalize_punctuation, ["a?!?!! b!?!? c ,d", "x?!y", "??!"]) == ["a!! b?? c,d", "x?!y", "??"]


def test_sentences(one):
    got = one(sentences.split_sentences, ["Он пришёл домой.Она ушла… Да. Стоп! это всё? Новая мысль тут"])
    assert got == [["Он пришёл домой.", "Она ушла...", "Стоп! это всё?", "Новая мысль тут"]]


def test_word_overlap_ignores_stopwords(one):
    f = lambda c: sentences.word_overlap(c, F.lit("Машина, сломалась вчера это"))
    assert one(f, ["машина сломалась сегодня", "это был", ""]) == [0.5, 0.0, 0.0]


def test_labels(one):
    assert one(labels.canonicalize, [" Enthusiasm ", "SAD", "love"]) == ["joy", "sadness", None]
    assert one(labels.display, ["joy", "love it", "fear"]) == ["Happiness", "Love it", "Fear"]
    assert one(labels.parse_annotations, ["['Anger', \"disgust\"]", "broken", "[]"]) == [["anger", "disgust"], [], []]
    with pytest.raises(Exception, match="unrecognised emotion label"):
        one(lambda c: labels.canonicalize(c, strict=True), ["love"])


def test_pair_cleaning(one):
    f = lambda c: clean_pair_text(c, "en")
    assert one(f, ["сat​ – ﬁne α≤2  „x‟"]) == ['cat - fine alpha<=2 "x"']


def test_cleaners(one):
    assert one(text.clean_cyrillic, ["Да, я ВИЖУ it 5 ёж"]) == ["да вижу ёж"]
    assert one(text.emotion_tokens, ["Wow!! ok? да!"]) == [["wow", "EXCLAMATION_MULTIPLE", "ok", "QUESTION", "да", "EXCLAMATION"]]
    with pytest.raises(ValueError):
        text.transform_for("nothing")
