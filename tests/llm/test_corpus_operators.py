"""Operators over the whole corpus against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from affect_engine.llm import decontam, fingerprint, line_dedup, lm, mixing, ngram_join, passages, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ws(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sentence(rng, n, vocabulary=3000):
    return " ".join(f"t{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact copies, near copies, shared passages and odd rows."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.choice([1, 3, 8, 60, 120]))) for i in range(60)]
    for i in range(60, 120):
        words = rows[rng.randrange(60)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    hub = sentence(rng, 100).split()
    for i in range(120, 200):
        words = list(hub)
        words[i % 100] = f"new{i}"
        rows.append((i, " ".join(words)))
    passage = sentence(rng, 55)
    for i in range(200, 210):
        rows.append((i, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}"))
    return [*rows, (300, None), (301, ""), (302, "  \n"), (303, "A b\tC"), (304, "a B c"), (305, "long " * 30_000)]


def test_jaccard_components(docs, corpus):
    sets = {}
    for i, text in corpus:
        w = ws(text)
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs(corpus)).collect()}
    assert found == {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_groups_by_one_hub_or_more(docs, monkeypatch):
    """A frequent shared part and chains of links, with one hub in every round."""
    rng = random.Random(9)
    shared = sentence(rng, 30).split()
    rows = []
    for i in range(40):
        own = sentence(rng, 3).split()
        rows.append((i, " ".join(shared + own)))
    rows += [(100 + i, " ".join(shared[: 30 - i])) for i in range(12)]
    monkeypatch.setattr(ngram_join, "HUBS", (1,))
    found = {r.doc_id: r.component_id for r in ngram_join.link(docs(rows), size=2, percent=80).collect()}
    monkeypatch.undo()
    same = {r.doc_id: r.component_id for r in ngram_join.link(docs(rows), size=2, percent=80).collect()}
    assert found == same
    assert len({found[i] for i in range(100, 112)}) == 1


def test_jaccard_of_no_rows(docs):
    assert ngram_join.link(docs([])).count() == 0
    assert [tuple(r) for r in ngram_join.link(docs([(7, None)])).collect()] == [(7, 0, 7)]


def test_prefix_keys_meet_for_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(2, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        frequent = np.sort(rng.choice(a, int(len(a) * rng.random()), replace=False))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 2**63, len(a) // 20).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            x, y = (ngram_join.prefix_keys(s, frequent, 85) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_unlike_texts_share_few_keys():
    """Sets with a common shingle or two, of which each was a key of all that have it, and light parts."""
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**64, 40, dtype=np.uint64)
    held = Counter()
    for _ in range(400):
        own = rng.integers(0, 2**64, 400, dtype=np.uint64)
        keys = ngram_join.prefix_keys(np.unique(np.concatenate([own, common])), ngram_join.NONE, 85)
        assert len(keys) < 0.4 * 440
        held.update(np.unique(keys).tolist())
    assert max(held.values()) < 20  # with single shingles as keys: 400


def test_keys_of_any_percentage_meet_and_none_is_empty():
    """At 80 percent a fifth of the parts was light, and empty ones were keys of unlike texts."""
    import numpy as np

    rng = np.random.default_rng(2)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    held = Counter()
    for _ in range(200):
        held.update(np.unique(ngram_join.prefix_keys(np.unique(fresh(700)), ngram_join.NONE, 80)).tolist())
    assert max(held.values()) == 1  # 12 with empty parts as keys
    met = 0
    for turn in range(1500):
        percent = (60, 80, 85, 95)[turn % 4]
        a = np.unique(fresh(int(rng.integers(1, (12, 60, 500)[turn % 3]))))
        out = rng.permutation(a)[: int(len(a) * rng.random() * (100 - percent) / 100)]
        b = np.union1d(np.setdiff1d(a, out), fresh(int(len(out) * rng.random())))
        frequent = np.sort(rng.choice(a, int(len(a) * rng.random()) if turn % 5 == 0 else 0, replace=False))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
            met += 1
            assert len(np.intersect1d(*(ngram_join.prefix_keys(s, frequent, percent) for s in (a, b))))
    assert met > 400


def test_parities_tell_long_unlike_sets_apart():
    """With 256 classes the bound on differing bits ruled out no pair of over 580 shingles at 80 percent."""
    import numpy as np

    rng = np.random.default_rng(3)
    differ = lambda a, b: sum(int(x ^ y).bit_count() if x ^ y >= 0 else 64 - (int(x ^ y) ^ -1).bit_count() for x, y in zip(ngram_join.parities(a).tolist(), ngram_join.parities(b).tolist(), strict=True))
    for n in (5, 600, 1500):
        a, b = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2))
        assert differ(a, b) * 180 > 20 * (len(a) + len(b))
        near = np.concatenate((a[n // 10 :], b[: n // 20]))
        assert differ(a, np.unique(near)) <= n // 10 + n // 20


def test_jaccard_of_eighty_percent_equals_brute_force(docs):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        words = sentence(rng, rng.choice((6, 12, 40, 150, 700))).split()
        for j in range(4):
            rows.append((4 * i + j, " ".join(words)))
            words = [w if rng.random() > 0.012 else f"{w}{j}" for w in words[rng.randrange(2) :]]
    cut = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} or {tuple(t.lower().split())} for i, t in rows}
    root = {i: i for i in cut}
    changed = True
    while changed:
        changed = False
        for a in cut:
            for b in cut:
                if root[a] < root[b] and 100 * len(cut[a] & cut[b]) >= 80 * len(cut[a] | cut[b]):
                    root = {i: root[a] if r == root[b] else r for i, r in root.items()}
                    changed = True
    assert 60 < len(set(root.values())) < 230
    assert {r.doc_id: r.component_id for r in ngram_join.link(docs(rows), size=5, percent=80).collect()} == root


def test_passages_of_over_fifty_words(docs, corpus):
    where = defaultdict(set)
    for i, text in corpus:
        w = ws(text)
        for j in range(len(w) - 50):
            where[tuple(w[j : j + 51])].add(i)
    shared = [s for s in where.values() if len(s) > 1]
    rows = passages.repeated(docs(corpus)).collect()
    classes = {r.doc_id: r.class_id for r in rows}
    for group in shared:
        assert len({classes.get(i) for i in group}) == 1 and None not in {classes.get(i) for i in group}
    assert not {i for i in classes if i >= 300}
    by_doc = {r.doc_id: r for r in rows if 200 <= r.doc_id < 210}
    assert len(by_doc) == 10
    for r in by_doc.values():
        assert r.start_word in range(36, 45) and r.stop_word in range(91, 100)


def test_passages_in_groups_of_unlike_texts(docs):
    """Pairs whose shared windows are mostly those of a line that many other texts have."""
    rng = random.Random(9)
    line = sentence(rng, 45, 10**6)
    rows = [(i, f"{sentence(rng, 60, 10**6)} {line} {sentence(rng, 60, 10**6)}") for i in range(60)]
    for i in range(100, 120, 2):
        own = sentence(rng, 6, 10**6)
        rows += [(j, f"{sentence(rng, 60, 10**6)} {line} {own} {sentence(rng, 60, 10**6)}") for j in (i, i + 1)]
    classes = {r.doc_id: r.class_id for r in passages.repeated(docs(rows)).collect()}
    assert classes == {j: i for i in range(100, 120, 2) for j in (i, i + 1)}


def test_every_planted_near_copy_is_found(docs):
    """Passages with one word changed, put in or left out, found as brute force finds them."""
    import numpy as np

    rng = random.Random(10)
    rows, edits = [], 0
    for i in range(0, 600, 2):
        own = sentence(rng, 50, 10**6).split()
        copy, at = list(own), rng.randrange(20, 30)
        copy[at : at + (edits % 3 != 1)] = ["new"] if edits % 3 < 2 else []
        edits += 1
        for j, words in enumerate((own, copy)):
            rows.append((i + j, f"{sentence(rng, 30, 10**6)} {' '.join(words)} {sentence(rng, 30, 10**6)}"))
    ids = defaultdict(lambda: len(ids))
    sets = {i: np.array([ids[tuple(ws(x)[k : k + 5])] for k in range(len(ws(x)) - 4)], np.uint64) for i, x in rows}
    near = [i for i in range(0, 600, 2) if passages.shared_passages(sets[i], sets[i + 1], 46, 5, 80)]
    classes = {r.doc_id: r.class_id for r in passages.repeated(docs(rows)).collect()}
    assert len(near) > 150
    assert [i for i in near if classes.get(i) != i or classes.get(i + 1) != i] == []


def test_least_run_is_what_edits_leave():
    assert passages.least_run(46, 5, 80) == 21
    assert passages.least_run(46, 5, 100) == 46


def test_passages_of_clean_or_no_documents(docs):
    rng = random.Random(2)
    clean = [(i, sentence(rng, 150, 10**6)) for i in range(30)]
    assert passages.repeated(docs(clean)).count() == 0
    assert passages.repeated(docs([])).count() == 0


def test_language_model_against_plain_counts(docs, corpus):
    train = F.col("doc_id") % 3 != 0
    rows = {r.doc_id: r for r in lm.score(docs(corpus), train).collect()}
    tokens = {i: [*ws(t), None] for i, t in corpus}
    counts = Counter(w for i, t in tokens.items() if i % 3 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert rows[i].base_score == pytest.approx(base)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert rows[i].score < 0
    held = [i for i in tokens if i % 3 == 0]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)


def test_language_model_is_a_distribution(docs):
    """Scores of all one-word continuations add up to the share the end token leaves."""
    texts = [(i, x) for i, x in enumerate(["a b", "a c", "b a", "a", "a b a"])]
    asked = [(10 + i, x) for i, x in enumerate(["", "a", "b", "c"])]
    frame = docs(texts + asked)
    rows = {r.doc_id: r for r in lm.score(frame, F.col("doc_id") < 10).collect()}
    assert all(0 < 10 ** rows[i].score < 1 for i, _ in asked)


def test_language_model_without_training_or_rows(docs):
    rows = lm.score(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows} == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert lm.score(docs([]), F.lit(True)).count() == 0


def test_em_prefers_the_better_estimate():
    import pandas as pd

    good = pd.DataFrame({"bucket": [3], "b2": [1], "b1": [9], "p2": [90.0], "p1": [1.0], "n": [100.0]})
    w = lm.learn_weights(good, 1000)
    assert w[3][0] > 0.9 and w[3].sum() == pytest.approx(1)


def likeness(a, b):
    x, y = (Counter(t.split("\n")) if t else Counter() for t in (a, b))
    differ, n = sum(((x - y) + (y - x)).values()), sum(x.values()) + sum(y.values())
    return 1.0 if n == 0 else (n - differ) / (n + differ)


def test_fingerprints_recover_all_differences(docs):
    rng = random.Random(4)
    rows = [(i * 7, "\n".join(sentence(rng, 2, 50) for _ in range(rng.choice([1, 2, 9, 40])))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, "x\n" * 500), (1004, "\n".join(map(str, range(900)))), (1005, "é" * 7)]
    frame = docs(rows)
    found = {r.doc_id: r for r in fingerprint.compare_with_edited(frame).collect()}
    texts = [t or "" for _, t in rows]
    assert len(found) == len(rows)
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i].n_chars == len(text)
        assert found[i].near_edited == pytest.approx(likeness(text, edited))
        assert found[i].near_next == pytest.approx(likeness(text, after))
    assert found[1002].fingerprint == found[21].fingerprint != found[0].fingerprint


def test_fingerprints_across_chunks(docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "CHUNK_DOCS", 3)
    rows = [(i * i, f"t{i}") for i in range(30)]
    found = {r.doc_id: r.next_text for r in fingerprint.with_next(docs(rows), "doc_id", "text").collect()}
    assert found == {i * i: f"t{(i + 1) % 30}" for i in range(30)}


def test_fingerprints_of_no_or_one_row(docs):
    assert fingerprint.compare_with_edited(docs([])).count() == 0
    one = fingerprint.compare_with_edited(docs([(1, "a\nb")])).first()
    assert one.near_next == 1.0


def plain_leaks(rows, items):
    out = set()
    for i, text in rows:
        flat = f" {' '.join(ws(text))} "
        out |= {(i, j) for j, t in items if ws(t) and f" {' '.join(ws(t))} " in flat}
    return out


def test_leaks_of_whole_items(spark, docs):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.choice([12, 40, 90, 200]), 800)) for i in range(30)] + [(90, None), (91, "")]
    rows = [(i, sentence(rng, 200, 800)) for i in range(60)]
    rows += [(100 + i, f"{sentence(rng, 70, 800)} {items[i][1].upper()} {sentence(rng, 50, 800)}") for i in range(30)]
    rows += [(200, None), (201, ""), (202, items[3][1]), (203, items[1][1].split()[0] * 3)]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(rows), table).collect()}
    assert found == plain_leaks(rows, items)
    assert decontam.leaks(docs([]), table).count() == 0
    assert decontam.leaks(docs(rows), table.limit(0)).count() == 0


def test_items_in_groups_give_the_same(spark, docs, monkeypatch):
    rng = random.Random(8)
    items = [(i, sentence(rng, 30, 500)) for i in range(12)]
    rows = [(i, f"{sentence(rng, 30, 500)} {items[i][1]}") for i in range(12)]
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "GROUP_WORDS", 100)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs(rows), table).collect()} == {(i, i) for i in range(12)}


def test_retrieval_equals_full_scores():
    """Block-max WAND loses no passage that full scoring would find."""
    import numpy as np
    import pyarrow as pa

    from affect_engine.llm.words import find_words, text_bytes

    rng = random.Random(6)
    items = [(i, sentence(rng, rng.choice([10, 30, 60]), 150)) for i in range(40)]
    texts = [sentence(rng, 140, 150) for _ in range(20)] + [items[0][1], ""]
    index = decontam.Index(items, threshold=0.6)
    words = find_words(*text_bytes(pa.array(texts)))
    found = {(d, i): s for d, i, s in index.retrieve(words)}
    first, expected = words.first, {}
    for d in range(len(texts)):
        own = words.hash[first[d] : first[d + 1]]
        n = max(1, -(-len(own) // index.stride) - 1)
        for w in range(n):
            end = None if w == n - 1 else w * index.stride + 2 * index.stride
            held = np.isin(index.vocabulary, own[w * index.stride : end])
            for p, item in enumerate(index.item_of):
                span = slice(index.terms.at[p], index.terms.at[p + 1])
                s = index.terms.weight[span][held[index.terms.ids[span]]].sum()
                if s >= 0.6:
                    expected[d, item] = max(expected.get((d, item), 0), s)
    assert found.keys() == expected.keys() and len(found) > 1
    assert all(found[k] == pytest.approx(v) for k, v in expected.items())


def test_boilerplate_lines_go_and_copies_stay(docs):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        lines = [sentence(rng, 12) for _ in range(4)]
        lines.insert(rng.randrange(5), "subscribe to our list")
        rows.append((i, "\n".join(lines), f"site{i % 15}"))
    copied = "\n".join(sentence(rng, 12) for _ in range(5))
    rows += [(100 + i, copied, f"site{i % 15}") for i in range(40)]
    rows += [(200 + i, f"{copied}\nextra {i}", f"site{i % 15}") for i in range(40)]
    rows += [(300, None, "site1"), (301, "", None), (302, "\n \n", "site2"), (None, "subscribe to our list", "site3")]
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(rows)).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        if i is not None and i < 60:
            assert found[i].text == "\n".join(x for x in text.split("\n") if x != "subscribe to our list")
            assert found[i].lines_removed == 1
        else:
            assert found[i].text == text


def test_near_threshold_lines_are_counted_exactly(docs):
    rng = random.Random(7)
    rows = [(i, f"{sentence(rng, 9)}\nnine sites\n{sentence(rng, 8)}", f"s{i % 9}") for i in range(45)]
    rows += [(100 + i, f"{sentence(rng, 9)}\nten sites\n{sentence(rng, 8)}", f"s{i % 10}") for i in range(50)]
    found = line_dedup.drop_boilerplate(docs(rows)).collect()
    assert {r.lines_removed for r in found if r.doc_id < 100} == {0}
    assert {r.lines_removed for r in found if r.doc_id >= 100} == {1}


def test_line_dedup_of_no_rows_and_clashing_names(docs):
    assert line_dedup.drop_boilerplate(docs([])).count() == 0
    odd = docs([(1, "a\nb")]).withColumns({"LINES_REMOVED": F.lit(9), "_own": F.lit(1), "_key": F.lit(2), "_places": F.lit(3)})
    found = line_dedup.drop_boilerplate(odd)
    assert found.columns[-1] == "_lines_removed"
    assert found.first()._own == 1


def test_mix_reaches_its_rates(spark, docs):
    rows = [(i, "x", "big" if i % 4 else "small") for i in range(4000)] + [(9000, None, None), (9001, "", "unwanted")]
    frame = docs(rows)
    targets = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("absent", 5.0), ("zero", 0.0)], "source string, weight double")
    rate = {r.source: r.rate for r in mixing.rates(frame, targets).collect()}
    n = len(rows)
    assert rate == {"big": pytest.approx(n / 7 / 3000), "small": pytest.approx(n / 7 / 1000)}
    targets = targets.filter("source <> 'absent'")
    out = mixing.mix(frame, mixing.rates(frame, targets), seed=3).collect()
    found = Counter(r.source for r in out)
    assert set(found) == {"big", "small"}
    assert all(abs(found[s] - n / 2) < 5 * math.sqrt(n / 2) for s in found)
    assert [r.mix_order for r in out] == sorted(r.mix_order for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(frame, mixing.rates(frame, targets), seed=3).collect()))


def test_mix_keeps_a_null_source_and_repeats_rows(spark, docs):
    frame = docs([(i, "x", None) for i in range(300)] + [(5, "x", None)]).withColumns(
        {"copy_no": F.lit("mine"), "_rate": F.lit(0), "_copies": F.lit(0), "_of": F.lit(0)}
    )
    targets = spark.createDataFrame([(None, 1.0)], "source string, weight double")
    out = mixing.mix(frame, mixing.rates(frame, targets, total=900.0)).collect()
    assert 700 < len(out) < 1100
    counts = Counter(r.doc_id for r in out)
    assert counts[5] % 2 == 0
    assert {r.copy_no for r in out} == {"mine"} and "_copy_no" in out[0]
    assert mixing.mix(frame.limit(0), mixing.rates(frame.limit(0), targets)).count() == 0


def test_even_mix_keeps_documents_without_a_source(docs):
    frame = docs([(i, "x", [None, "a", "b"][i % 3]) for i in range(900)])
    found = Counter(r.source for r in mixing.mix(frame, queries.even_rates(frame)).collect())
    assert set(found) == {None, "a", "b"} and all(200 < n < 400 for n in found.values())


def test_mix_at_rates_above_five_hundred(spark, docs):
    frame = docs([(i, "x", "rare" if i < 20 else "common") for i in range(60)])
    rate = spark.createDataFrame([("rare", 1730.0), ("common", 500.0)], "source string, rate double")
    copies = Counter((r.source, r.doc_id) for r in mixing.mix(frame, rate, seed=4).collect())
    for source, n, mean in (("rare", 20, 1730.0), ("common", 40, 500.0)):
        own = [c for (s, _), c in copies.items() if s == source]
        assert len(own) == n and abs(sum(own) / n - mean) < 5 * math.sqrt(mean / n)
        spread = sum((c - mean) ** 2 for c in own) / n / mean
        assert 0.3 < spread < 2.5
    assert len({c for (s, _), c in copies.items() if s == "rare"}) > 5


def test_stretches_with_matches_on_two_diagonals():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        b = rng.integers(0, 40, int(rng.integers(60, 200))).astype(np.uint64)
        a = np.concatenate([b[30:60], b[:30], rng.integers(0, 40, 40).astype(np.uint64)])
        for x, y, u, v in passages.shared_passages(a, b, 20, 5, 80):
            both = np.intersect1d(a[x:y], b[u:v])
            assert 100 * len(both) >= 80 * len(np.union1d(a[x:y], b[u:v])) and y - x >= 20 and v - u >= 20
