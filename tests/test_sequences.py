"""Ordered scans, greedy packing and segmentation against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from affect_engine.functions.vocab import OVERLAP_STOPWORDS
from affect_engine.operators import evaluation, greedy, scan, scenes, segments, timeline


def test_scan_crosses_chunks(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)])) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    out = scan.ordered_scan(
        df, ["k"], ["i"], scan.chunk_of(F.col("i"), 7), position="pos", sums={"s": F.coalesce("v", F.lit(0))},
        lags={"prev": F.col("v")}, leads={"next": F.col("v")}, carry={"last": F.col("v")}, highs={"high": F.col("v")},
    ).collect()
    for r in out:
        own = [v for k, _, v in rows if k == r.k]
        seen = [v for v in own[: r.i + 1] if v is not None]
        assert r.pos == r.i + 1
        assert r.s == sum(v or 0 for v in own[: r.i])
        assert r.prev == (own[r.i - 1] if r.i else None)
        assert r.next == (own[r.i + 1] if r.i < 39 else None)
        assert r["last"] == (seen[-1] if seen else None)
        assert r.high == (max(seen) if seen else None)


def test_quantiles_match_numpy(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([rng.random(), 0.5])) for k in range(3) for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "k int, v double")
    out = scan.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}, scan.chunk_of(F.col("v"), 0.05))
    for r in out.collect():
        want = np.percentile([v for k, v in rows if k == r.k], [10, 50, 90])
        assert np.allclose([r.a, r.b, r.c], want)


def test_scores_packed_into_a_millionth(spark):
    """Borders come from the values, so no range holds them all."""
    rng = np.random.default_rng(6)
    values = 0.4 + np.round(rng.random(4000) * 1e-6, 12)
    hit = rng.random(4000) < 0.3
    rows = [(i % 2, float(v), bool(h)) for i, (v, h) in enumerate(zip(values, hit, strict=True))]
    df = spark.createDataFrame(rows, "k int, v double, y boolean").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[1] for r in scan.by_ranges(df, ["v"]).groupBy(scan.RANGE).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2000
        out = scan.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5}).collect()
        area = {r.k: r.auc for r in evaluation.roc_auc(df, ["k"], "v", "y").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in out:
        assert np.allclose([r.a, r.b], np.percentile(values[r.k :: 2], [10, 50]), rtol=0, atol=1e-15)
    for k, auc in area.items():
        a, b = values[k::2][hit[k::2]], values[k::2][~hit[k::2]]
        want = (np.sign(a[:, None] - b[None]).mean() + 1) / 2
        assert abs(auc - want) < 1e-12


@pytest.mark.parametrize("chunk", [3, 2048])
def test_starts_follow_the_chain(spark, chunk):
    rng = random.Random(3)
    rows = [(k, i, i + rng.randint(1, 6)) for k in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i long, nxt long")
    got = {(r.k, r.i) for r in greedy.mark_starts(df, ["k"], "i", "nxt", "s", chunk).where("s").collect()}
    want = set()
    for k in range(4):
        jump = {i: n for kk, i, n in rows if kk == k}
        here = 0
        while here in jump:
            want.add((k, here))
            here = jump[here]
    assert got == want


def test_scenes_fold(spark, monkeypatch):
    monkeypatch.setattr(scenes, "SHOT_CHUNK", 5)
    rng = random.Random(4)
    rows, want = [], {}
    for v in range(3):
        at, shots = 0.0, []
        for i in range(60):
            at += rng.choice([0, 0, 0, 1, 8])
            end = at + rng.randint(1, 30)
            shots.append((v, i, at, end))
            at = end
        rows += [(v, i, float(a), float(b)) for v, i, a, b in shots]
        found = []
        for _, i, a, b in shots:
            if found and b - found[-1][0] <= 100 and a - found[-1][1] <= 5:
                found[-1] = (found[-1][0], b, found[-1][2] + 1)
            else:
                found.append((a, b, 1))
        want[v] = found
    df = spark.createDataFrame(rows, "video_id int, scene_id long, start double, end double")
    got = scenes.global_scenes(df, max_duration=100.0).orderBy("video_id", "global_scene_id").collect()
    for v in range(3):
        assert [(r.start, r.end, r.shot_count) for r in got if r.video_id == v] == want[v]


@pytest.mark.parametrize(("chunk", "fan"), [(4, 2), (7, 3), (1024, 64)])
def test_scenes_with_ends_in_any_order(spark, chunk, fan):
    rng = random.Random(chunk)
    rows, want = [], {}
    for v in range(4):
        at, scene = 0.0, None
        for i in range(rng.choice([1, 5, 120, 150])):
            a, b = at, at + rng.choice([1, 5, 40, 90, 160])
            at += rng.choice([0, 1, 3, 60])
            rows.append((v, i, a, b))
            if scene is None or b - scene[1] > 100 or a - scene[2] > 5:
                scene = [i, a, b]
            scene[2] = b
            want[v, i] = scene[0]
    df = spark.createDataFrame(rows, "v int, i long, start double, end double").repartition(3)
    rule = greedy.Extent("start", "end", 100.0, 5.0)
    got = greedy.follow(df, ["v"], "i", rule, "scene", ["end"], chunk=chunk, fan=fan).collect()
    assert {(r.v, r.i): r.scene for r in got} == want
    assert {(r.v, r.i): r.end for r in got} == {(v, i): e for v, i, _, e in rows}


def test_segments_longer_than_many_chunks(spark):
    rows = [(k, i, float(i), float(i + 1)) for k in (1, 2) for i in range(400)]
    rows += [(3, i, float(i), 5000.0 if i == 301 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i long, start double, end double")
    rule = greedy.Extent("start", "end", 330.0)
    got = greedy.follow(df, ["k"], "i", rule, "s", chunk=5, fan=2).groupBy("k").agg(F.sort_array(F.collect_set("s")).alias("s"))
    assert {r.k: r.s for r in got.collect()} == {1: [0, 330], 2: [0, 330], 3: [0, 301]}


def test_given_successors_that_skip_chunks(spark):
    rng = random.Random(9)
    rows = [(k, i, i + rng.choice([1, 2, 17, 60]) if rng.random() < 0.97 else None) for k in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i long, nxt long")
    got = {(r.k, r.i): r.s for r in greedy.follow(df, ["k"], "i", "nxt", "s", chunk=8).collect()}
    for k in range(3):
        jump, here, opens = {i: n for kk, i, n in rows if kk == k}, 0, 0
        for i in range(300):
            if i == here:
                opens = i
                here = jump[i]
            assert got[k, i] == opens


# --- segments: the rules once more, in plain Python --------------------------

CAP = "[А-ЯA-ZЁ«]"


def py_sentences(text):
    text = re.sub(r"\s+", " ", text).strip()
    text = re.sub(rf"([.!?…])({CAP})", r"\1 \2", text)
    text = re.sub(r"\.{3,}", "...", text.replace("…", "..."))
    parts = re.split(rf"(?<=[.!?…])\s+(?={CAP})", text)
    return [p for p in parts if len(p.split()) >= 2 and re.search(r"\w", p)]


def py_split(sentence, top):
    words = sentence.split()
    if len(words) <= top:
        return [sentence]
    packs, count = [], 0
    for part in re.split(r"(?<=[,;—])\s+", sentence):
        n = len(part.split())
        if packs and count + n <= top:
            packs[-1] += " " + part
            count += n
        else:
            packs.append(part)
            count = n
    out = []
    for p in packs:
        w = p.split()
        out += [" ".join(w[i : i + top]) for i in range(0, len(w), top)]
    return out


def py_overlap(a, b):
    def bag(t):
        ws = {re.sub(r"[^\w]", "", w) for w in t.lower().split()}
        return {w for w in ws if len(w) >= 3 and w not in OVERLAP_STOPWORDS}

    x, y = bag(a), bag(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def py_segments(words, lim):
    """words: (word, start, end, probability) of one scene."""
    full = " ".join(w[0] for w in words)
    pieces = [p for s in (py_sentences(full) or [full]) for p in py_split(s, lim.max_words)]
    data, at = [], 0
    for p in pieces:
        n = len(p.split())
        own = words[at : at + n]
        at += len(own)
        if own:
            data.append((p, own, n))
    segs, cur = [], []
    for d in data:
        count = sum(c[2] for c in cur)
        if cur and (
            count + d[2] > lim.max_words
            or len(cur) + 1 > lim.max_sentences
            or (count >= max(lim.min_words, lim.target_words) and py_overlap(cur[-1][0], d[0]) < lim.min_similarity)
        ):
            segs.append(cur)
            cur = []
        cur.append(d)
    tail = cur if segs and sum(c[2] for c in cur) < lim.min_words else None
    if tail is None:
        segs.append(cur)
    out = [
        [" ".join(c[0] for c in s), len(s), sum(len(c[1]) for c in s), round(s[-1][1][-1][2], 2)] for s in segs
    ]
    if tail:
        out[-1] = [
            out[-1][0] + " " + " ".join(c[0] for c in tail),
            out[-1][1] + len(tail),
            out[-1][2] + sum(c[2] for c in tail),
            tail[-1][1][-1][2],
        ]
    return out


def test_local_segments_match_plain_python(spark, monkeypatch):
    monkeypatch.setattr(segments, "WORD_CHUNK", 8)
    rng = random.Random(5)
    stock = ["дом", "река", "город.", "Мы", "шли,", "долго", "Потом", "стало", "тихо!", "конец.Начало", "и", "— ", "ночь…", "Я"]
    limits = segments.Limits(min_words=4, target_words=6, max_words=12, max_sentences=3)
    rows, want = [], {}
    for scene in range(6):
        n = rng.randint(1, 90)
        words = []
        for i in range(n):
            words.append((rng.choice(stock).strip(), scene * 1000 + i * 1.0, scene * 1000 + i + 0.5, 0.5))
        want[scene] = py_segments(words, limits)
        rows += [(1, scene, i, w, a, b, p, scene) for i, (w, a, b, p) in enumerate(words)]
    df = spark.createDataFrame(
        rows,
        "video_id int, segment_id long, i long, word string, start double, end double, probability double, global_scene_id long",
    )
    frame = spark.createDataFrame([(1, s, s * 1000.0, s * 1000.0 + 999) for s in range(7)], "video_id int, global_scene_id long, start double, end double")
    got = segments.local_segments(df, frame, limits).orderBy("local_segment_id").collect()
    for scene in range(6):
        mine = [[r.text, r.sentence_count, r.word_count, r.end] for r in got if r.global_scene_id == scene]
        assert mine == want[scene]
    silent = [r for r in got if r.global_scene_id == 6]
    assert len(silent) == 1 and not silent[0].has_speech
    assert [r.local_segment_id for r in got] == list(range(len(got)))


def test_long_sentences_are_cut_at_clauses(spark):
    rng = random.Random(6)
    words = [rng.choice(["a", "bb,", "c;", "dd"]) for _ in range(120)]
    df = spark.createDataFrame([(1, 0, 0, i, w, 120) for i, w in enumerate(words)], "video_id int, global_scene_id long, sid long, p long, token string, n long")
    cut = segments.split_long(df, 7).orderBy("p").collect()
    got = {}
    for r in cut:
        got.setdefault(r.part, []).append(r.token)
    assert [" ".join(x) for x in got.values()] == py_split(" ".join(words), 7)


def spline_at(x, y, at):
    """Not-a-knot cubic through (x, y) by one dense solve, extended beyond its ends."""
    n = len(x)
    if n == 1:
        return np.full(len(at), y[0])
    if n < 4:
        return np.polyval(np.polyfit(x - x[0], y, n - 1), at - x[0])
    h = np.diff(x)
    d = np.diff(y) / h
    system, right = np.zeros((n, n)), np.zeros(n)
    rows = np.arange(1, n - 1)
    system[rows, rows - 1], system[rows, rows], system[rows, rows + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    right[1:-1] = 6 * np.diff(d)
    system[0, :3] = h[1], -(h[0] + h[1]), h[0]
    system[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(system, right)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = x[i + 1] - at, at - x[i]
    return (
        (m[i] * a**3 + m[i + 1] * b**3) / (6 * h[i])
        + (y[i] / h[i] - m[i] * h[i] / 6) * a
        + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b
    )


@pytest.mark.parametrize("chunk", [3, 4, 7, 1024])
def test_spline_in_chunks_on_uneven_knots(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows, want = [], {}
    for v, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 60, 300]):
        t = np.cumsum(rng.choice([0.01, 0.5, 1, 7, 300], n))
        y = rng.random((2, n))
        rows += [(v, k, float(t[k]), float(y[0, k]), float(y[1, k])) for k in range(n)]
        at = np.concatenate([t[:-1] + np.diff(t) * 0.3, [t[0] - 0.1, t[-1] + 0.1]])
        # A spline is fixed by its knots' values and curvatures; both are read off at inner points.
        want[v] = (t, y, at)
    df = spark.createDataFrame(rows, "video_id int, k long, t double, arousal double, valence double").repartition(3)
    got = timeline.spline(df, chunk=chunk).orderBy("video_id", "k").toPandas()
    for v, (t, y, at) in want.items():
        own = got[got.video_id == v]
        assert list(own.k) == list(range(len(t)))
        for name, values in (("arousal", y[0]), ("valence", y[1])):
            assert np.allclose(own[name], values)
            if len(t) == 1:
                continue
            m = own[f"{name}_m"].to_numpy()
            i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
            h, a, b = t[i + 1] - t[i], t[i + 1] - at, at - t[i]
            curve = (m[i] * a**3 + m[i + 1] * b**3) / (6 * h) + (values[i] / h - m[i] * h / 6) * a + (values[i + 1] / h - m[i + 1] * h / 6) * b
            true = spline_at(t, values, at)
            assert np.allclose(curve, true, rtol=1e-7, atol=1e-7 * np.abs(true).max())


def test_spline_of_ten_thousand_knots(spark):
    """Every equation of the global spline holds, across ten chunks."""
    rng = np.random.default_rng(0)
    n = 10_000
    t = np.cumsum(rng.choice([0.02, 1, 3, 90], n))
    y = rng.random((2, n))
    df = spark.createDataFrame([(1, k, float(t[k]), float(y[0, k]), float(y[1, k])) for k in range(n)], "video_id int, k long, t double, arousal double, valence double")
    got = timeline.spline(df).orderBy("k").toPandas()
    h = np.diff(t)
    for name, values in (("arousal", y[0]), ("valence", y[1])):
        m = got[f"{name}_m"].to_numpy()
        d = np.diff(values) / h
        right = 6 * np.diff(d)
        inner = h[:-1] * m[:-2] + 2 * (h[:-1] + h[1:]) * m[1:-1] + h[1:] * m[2:]
        scale = np.abs(right) + 2 * (h[:-1] + h[1:]) * np.abs(m[1:-1])
        assert (np.abs(inner - right) <= 1e-9 * scale.max()).all() and (np.abs(inner - right) / scale).max() < 1e-8
        for i, j, k in ((0, 1, 2), (-1, -2, -3)):
            near, far = (h[0], h[1]) if i == 0 else (h[-1], h[-2])
            assert abs(far * m[i] - (near + far) * m[j] + near * m[k]) < 1e-9 * np.abs(far * m[i]).clip(1e-3)


def test_local_spline_equals_the_global_one(spark):
    rng = np.random.default_rng(7)
    n, points = 300, 40
    edges = np.concatenate([[0], np.cumsum(rng.uniform(1, 5, n))])
    rows = [(1, i, float(edges[i]), float(edges[i + 1]), float(rng.random()), float(rng.random()), 0, 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id int, segment_id long, start double, end double, arousal double, valence double, emotion_id int, agreement double")
    marks = timeline.knots(df)
    curve = timeline.cubic(timeline.bracket(timeline.grid(df, points), marks), marks).orderBy("g").collect()
    x = np.array([(r[2] + r[3]) / 2 for r in rows])
    at = np.linspace(edges[0], edges[-1], points)
    want = spline_at(x, np.array([r[4] for r in rows]), at)
    assert np.allclose([r.arousal for r in curve], want, atol=1e-9)


def test_gaussian_keeps_a_constant(spark):
    df = spark.createDataFrame([(1, g, 0.25) for g in range(20)], "video_id int, g int, v double")
    assert all(abs(r.v - 0.25) < 1e-12 for r in timeline.gaussian(df, ["v"], 20).collect())
