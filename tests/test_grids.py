"""Smoothing and label shares along the grid against plain loops."""

import math
import random

from affect_engine.operators import timeline


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gaussian_with_gaps(spark, monkeypatch):
    monkeypatch.setattr(timeline, "GRIDS", 2)
    rng, points = random.Random(3), 9
    rows = [(v, g, None if rng.random() < 0.2 else rng.uniform(-0.5, 1.5)) for v in range(5) for g in range(points) if v != 3 or g % 4 == 0]
    rows += [(7, g, None) for g in range(points)]
    df = spark.createDataFrame(rows, "v long, g int, x double").repartition(2)
    out = timeline.gaussian(df, ["x"], points, sigma=0.5, key="v")
    # A grid goes through one shuffle as it is, not once per tap.
    shape = plan(out)
    assert shape.count("Exchange hash") == 1 and "Join" not in shape, shape
    got = {(r.v, r.g): r.x for r in out.collect()}
    weight = {o: math.exp(-0.5 * (o / 0.5) ** 2) for o in range(-2, 3)}
    at = {(v, g): x for v, g, x in rows}
    assert got.keys() == at.keys()
    for (v, g), x in got.items():
        found = []
        for o, w in weight.items():
            s = (g + o) % (2 * points)
            value = at.get((v, s if s < points else 2 * points - 1 - s))
            if value is not None:
                found.append(w / sum(weight.values()) * value)
        assert (x is None) == (not found)
        assert x is None or abs(x - max(0.0, min(1.0, sum(found)))) < 1e-12


def test_label_mix_with_gaps_and_nulls(spark):
    rng, points, half = random.Random(4), 12, 3
    rows = [(v, g, rng.choice([None, 0, 1, 5])) for v in range(4) for g in range(points) if v != 2 or g % 5]
    df = spark.createDataFrame(rows, "v long, g int, emotion_id int").repartition(2)
    out = timeline.label_mix(df, points, half, key="v")
    shape = plan(out)
    assert shape.count("Exchange hash") == 1 and "Join" not in shape, shape
    want, at = {}, {(v, g): e for v, g, e in rows}
    for v, g, e in rows:
        if g in (0, points - 1):
            want[v, g, e] = 1.0
            continue
        mix = {}
        for o in range(-half, half):
            if (v, g + o) in at:
                mix[at[v, g + o]] = mix.get(at[v, g + o], 0) + 1 / (1 + abs(o))
        want |= {(v, g, n): w / sum(mix.values()) for n, w in mix.items()}
    got = {(r.v, r.g, r.emotion_id): r.share for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
