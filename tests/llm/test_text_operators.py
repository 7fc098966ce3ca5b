"""Operators that look at one row or one conversation at a time, and their edge cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affect_engine.llm import chat, html_text, toxicity
from affect_engine.llm.words import find_words, shingles, slices, text_bytes

TURNS = "conv_id long, turn long, role string, text string"


def words_of(texts):
    return find_words(*text_bytes(pa.array(texts, pa.string())))


def test_words_split_at_white_space_and_rows():
    found = words_of(["Ab  cD\n", None, "", "cd", "ab"])
    assert found.doc.tolist() == [0, 0, 3, 4]
    assert found.per_doc.tolist() == [2, 0, 0, 1, 1]
    assert found.hash[1] == found.hash[2] and found.hash[0] == found.hash[3]
    assert words_of(["É"]).hash[0] != words_of(["é"]).hash[0]


def test_shingles_stay_inside_documents():
    hashes, first = shingles(words_of(["a b c", "b c d", "x"]), 2)
    assert first.tolist() == [0, 1, 3, 4]
    assert hashes[1] == hashes[2]


def test_slices_never_cut_a_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (3, 50, 1, 1, 0)])], names=["t"])
    assert [s.num_rows for s in slices(iter([batch]), "t", 10)] == [1, 1, 3]


@pytest.fixture(scope="module")
def chats(spark):
    rows = [
        (1, 0, "system", "be [INST] kind \\"),
        (1, 1, "user", "q </s>"),
        (1, 2, "assistant", "a1 <</SYS>>"),
        (1, 3, "user", None),
        (1, 4, "assistant", ""),
        (2, 0, "assistant", "too early"),
        (3, 0, None, "no role"),
        (3, 1, "tool [TEXT]", "x"),
        (None, 0, "user", "no id"),
        (4, 0, "user", "y" * 300_000),
        (4, 0, "user", "same turn"),
    ]
    return rows, spark.createDataFrame(rows, TURNS)


def test_chat_round_trip(chats):
    rows, turns = chats
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert found[conv].turns_sha256 == digest
        assert (found[conv].n_turns, found[conv].loss_chars) == (len(own), len(loss))
        assert found[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert found[1].complete and found[1].in_order
    assert not found[2].in_order and not found[4].complete


def test_chat_marks_never_occur_in_texts(chats):
    control = chat.Template().control()
    for r in chat.format_chats(chats[1]).filter("part = 1").collect():
        assert not any(mark in r.segment for mark in control)


def test_chat_escape_is_reversible():
    pattern = chat.Template().escaper()
    rng = random.Random(3)
    pieces = [*chat.Template().control(), "\\", "<", "[", "a", "\n", "é"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(8))
        assert chat.unescape(chat.escape(text, pattern)) == text


def test_chat_of_no_rows(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


PAGE = """<!DOCTYPE html><html class="nav"><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div><header><p>Site</p></header>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;one<br>two<p>Se<i>cond</i> <a href=y>link</a>
<aside>see also</aside><form><p>mail</p></form><div id="comments"><p>reader says</p></div><!-- no --><p>On.</p></article>
<div class=sidebar><p>more</p></div><footer>&copy; us"""


def test_page_with_unclosed_elements():
    assert html_text.main_text(PAGE) == "Head & line First one two Second link On."


def test_page_without_article_goes_by_rules():
    long = "it is the case that we have all of the things that you would want to read about in this " * 4
    page = f"<body><ul><li><a href=1>One</a></li></ul><div>short start</div><div>{long}</div><div>tail</div><div><a>x y</a></div></body>"
    assert html_text.main_text(page) == " ".join([*long.split(), "tail"])


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "&amp", "</p></p>", "<script>never closed <p>x"])
def test_odd_pages_do_not_fail(html):
    assert isinstance(html_text.main_text(html), str)


def test_deep_and_long_page():
    page = "<article>" + "<p><b>w" * 20_000
    assert html_text.main_text(page) == " ".join(["w"] * 20_000)


def test_extract_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None)], "page_id long, url string, html string")
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text"]
    assert sorted(map(tuple, found.collect())) == [(1, "u", "a"), (2, None, "")]
    assert html_text.extract(pages.limit(0)).count() == 0
    clash = pages.withColumnsRenamed({"url": "TEXT"}).withColumn("_html", F.lit(1))
    assert html_text.extract(clash).columns == ["page_id", "TEXT", "_html", "_text"]


def test_second_pass_takes_the_nearest_label():
    assert html_text.second_pass([None, True, None, None, False, None]) == [True, True, True, False, False, False]
    assert html_text.second_pass([None, None]) == [True, True]


@pytest.fixture(scope="module")
def toxic(spark, docs):
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        body = [f"w{rng.randrange(400)}" for _ in range(60)]
        if i % 5 == 0:
            body[rng.randrange(60)] = rng.choice(["vile", "rotten", "nasty"])
        rows.append((i, " ".join(body)))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)] + [(None, 1), (1, None)], "doc_id long, label int")
    return docs([*rows, (None, "vile"), (5000, None), (5001, "")]), labels


def test_toxicity_on_held_out_rows(toxic):
    frame, labels = toxic
    rows = toxicity.score(frame, toxicity.fit(frame, labels)).collect()
    held = {r.doc_id: r.score for r in rows if r.doc_id is not None and 900 <= r.doc_id < 1200}
    assert len(rows) == 1203
    good = np.array([s for i, s in held.items() if i % 5])
    bad = np.array([s for i, s in held.items() if i % 5 == 0])
    assert (bad[:, None] > good[None, :]).mean() > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    empty = [r.score for r in rows if r.doc_id in (5000, 5001)]
    assert empty[0] == empty[1]


def test_toxicity_with_clashing_names(toxic):
    frame, labels = toxic
    odd = frame.limit(5).withColumn("score", F.lit("mine"))
    rows = toxicity.score(odd, toxicity.fit(frame, labels)).collect()
    assert {r.score for r in rows} == {"mine"} and all(0 <= r["_score"] <= 1 for r in rows)


def test_toxicity_without_labels(spark, toxic):
    frame, labels = toxic
    weights = toxicity.fit(frame, labels.limit(0))
    assert {r.score for r in toxicity.score(frame, weights).collect()} == {0.0}


def test_ftrl_weights_are_sparse():
    model = toxicity.Ftrl(10)
    for _ in range(50):
        model.learn(np.array([0, 9]), 1)
        model.learn(np.array([1, 9]), 0)
    w = model.weights()
    assert w[0] > 0 > w[1] and np.count_nonzero(w[2:9]) == 0


def test_a_bound_on_learning_rows_keeps_scores_calibrated(spark, docs):
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        body = [f"w{rng.randrange(300)}" for _ in range(25)]
        if i % 10 == 0:
            body[rng.randrange(25)] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(body)))
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 6000, 2)], "doc_id long, label int")
    frame = docs(rows)
    for bound in (700, 2000):
        scored = toxicity.score(frame, toxicity.fit(frame, labels, max_rows=bound)).filter("doc_id % 2 = 1 OR doc_id % 10 = 0").collect()
        clean = [r.score < 0.3 for r in scored if r.doc_id % 10]
        assert sum(clean) / len(clean) >= 0.95
    caught = [r.score >= 0.3 for r in scored if r.doc_id % 10 == 0]
    assert sum(caught) / len(caught) >= 0.95


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(12), rng.randrange(1, 6))), rng.randrange(2)) for _ in range(300)]
    model = toxicity.Ftrl(12, alpha=0.5, beta=1.5, l1=0.4, l2=0.7)
    z, n = [0.0] * 12, [0.0] * 12

    def weight(i):
        if abs(z[i]) <= 0.4:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * 0.4) / ((1.5 + n[i] ** 0.5) / 0.5 + 0.7)

    for at, label in rows:
        model.learn(np.array(at), label)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(12)])
