"""The vector index and over-sampling against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affect_engine.operators import neighbours

SCHEMA = "id long, v array<double>, c string"


def points(spark, n=600, dims=8, seed=1, classes="a"):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dims)) * 4
    x = middles[rng.integers(0, 12, n)] + rng.normal(size=(n, dims))
    x[n // 2 : n // 2 + 20] = x[:20]  # ties
    labels = [classes[i % len(classes)] for i in range(n)]
    return x, labels, spark.createDataFrame([(i, [float(c) for c in v], k) for i, (v, k) in enumerate(zip(x, labels, strict=True))], SCHEMA)


def all_pairs(x, k, metric, labels=None):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
    else:
        s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    s = np.round(s, 9)
    np.fill_diagonal(s, -np.inf)
    if labels is not None:
        s[np.array(labels)[:, None] != np.array(labels)[None]] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s))[:, :k]
    return [[int(j) for j in row if np.isfinite(s[i, j])] for i, row in enumerate(order)]


def found_by(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.probe, {})[r["rank"]] = r.neighbour
    return {p: [v[i] for i in sorted(v)] for p, v in out.items()}


@pytest.mark.parametrize(("metric", "within", "first"), [("cosine", None, 1), ("euclidean", None, 2), ("euclidean", "c", 1)])
def test_exact_search_equals_all_pairs(spark, monkeypatch, metric, within, first):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    x, labels, df = points(spark, classes="aaab")
    df = df.withColumn("list", F.lit("clash"))
    got = found_by(neighbours.nearest(df, df, "id", "v", 4, metric=metric, within=within, lists=20, first=first))
    want = all_pairs(x, 4, metric, labels if within else None)
    assert got == dict(enumerate(want))


def test_recall_of_the_first_lists(spark):
    x, _, df = points(spark, n=4000, dims=16, seed=3)
    probes = df.where("id % 100 = 0")
    got = found_by(neighbours.nearest(probes, df, "id", "v", 10, exact=False, lists=40, first=8))
    want = all_pairs(x, 10, "cosine")
    hits = sum(len(set(got[i]) & set(want[i])) for i in range(0, 4000, 100))
    assert hits / (10 * 40) >= 0.9
    assert found_by(neighbours.nearest(probes, df, "id", "v", 10, lists=40)) == {i: want[i] for i in range(0, 4000, 100)}


def test_odd_vectors_have_no_neighbours(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [0.0, 0.0], "a"), (4, None, "a"), (5, [None, 1.0], "a"), (6, [float("nan"), 1.0], "a"), (7, [1.0], "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_by(neighbours.nearest(df, df, "id", "v", 3)) == {1: [2], 2: [1]}
    none = neighbours.nearest(df.where("id = 4"), df.where("id = 4"), "id", "v", 3)
    assert none.columns == ["probe", "neighbour", "score", "rank"] and none.count() == 0
    pairs = {(r.probe, r.neighbour) for r in neighbours.similarities(df, df, "id", "v").collect()}
    assert pairs == {(1, 2), (2, 1)}


def test_made_points_lie_between_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "COPIES", 7)
    x, labels, df = points(spark, n=300, classes="aaaaaaaabbb")
    df = df.unionByName(spark.createDataFrame([(1000, [9.0] * 8, "only"), (1001, None, "a"), (1002, [1.0] * 8, None)], SCHEMA))
    near = all_pairs(x, 5, "euclidean", labels)
    out = neighbours.oversample(df, "id", "c", "v").collect()
    made = [r for r in out if r.copy is not None]
    assert sorted(r.id for r in out if r.copy is None) == sorted([*range(300), 1000, 1001, 1002])
    top = labels.count("a")
    assert [sum(r.c == c for r in made) for c in ("a", "b", "only")] == [0, top - labels.count("b"), top - 1]
    for r in made:
        assert r.id is None
        if r.c == "only":
            assert r.neighbour is None and r.v == [9.0] * 8
            continue
        assert r.neighbour in near[r.seed_key]
        a, b = x[r.seed_key], x[r.neighbour]
        way = np.dot(np.array(r.v) - a, b - a) / max(np.dot(b - a, b - a), 1e-30)
        assert -1e-9 <= way <= 1 and np.allclose(a + way * (b - a), r.v, atol=1e-9)
    used = [r.seed_key for r in made if r.c == "b"]
    assert max(used.count(k) for k in set(used)) - min(used.count(k) for k in set(used)) <= 1


def test_shelves_send_a_probe_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(700, 8)), 1)
    x[50:90] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(neighbours, "SHELF_ROWS", 150)
    monkeypatch.setattr(neighbours, "SHELF_PROBES", 90)
    monkeypatch.setattr(neighbours, "STEP_ROWS", 37)
    sent = []
    kept = neighbours._shelved
    monkeypatch.setattr(neighbours, "_shelved", lambda visits, *rest: sent.append(visits) or kept(visits, *rest))
    for metric in ("cosine", "euclidean"):
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if metric == "cosine" else x
        scores = unit @ unit.T if metric == "cosine" else -((x[:, None] - x[None]) ** 2).sum(axis=2)
        scores = np.round(scores, 9)
        np.fill_diagonal(scores, -np.inf)
        got = {}
        for r in neighbours.nearest(df, df, "id", "v", 4, metric=metric, lists=30, first=2).collect():
            got.setdefault(r.probe, {})[r.rank] = r.score
        assert all(np.allclose([got[i][n] for n in (1, 2, 3, 4)], np.sort(scores[i])[::-1][:4], atol=1e-8) for i in range(700))
        most = sent[-1].groupBy("probe").count().agg({"count": "max"}).first()[0]
        assert most <= 5


def test_best_probe_is_the_largest_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(300, 6)), 1))]
    rows += [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    best = neighbours.similarities(df, df, "id", "v", best=True)
    want = {}
    for r in neighbours.similarities(df, df, "id", "v").collect():
        want[r.neighbour] = max(want.get(r.neighbour, (-2, 0)), (r.cosine, -r.probe))
    assert {r.neighbour: (r.cosine, -r.probe) for r in best.collect()} == want
