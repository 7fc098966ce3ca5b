"""Centroid clusters, whitening and suffix-array dedup against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from affect_engine.llm import centroids, suffixes, whitening

VECTORS = "vec_id long, embedding array<float>, cluster string, Key int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


def random_vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in rng.normal(size=dims) * np.linspace(1, 0.1, dims)]) for i in range(n)]


def odd_vectors(dims):
    return [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1))]


# Clusters -------------------------------------------------------------------


def plain_clusters(rows, dims, clusters, rounds, scale=256, seed="2"):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    mids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(mids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(mids)):
            group = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if group:
                mids[c] = [sum(col) // len(group) for col in zip(*group, strict=True)]
    return sorted(((i, c, d) for i, v in kept for d, c in [nearest(v)]), key=str), mids


def test_clusters_equal_a_plain_version(spark):
    rows = random_vectors(150, 6)
    rows += [(i + 200, v) for i, v in rows[:40]]  # ties
    rows += [(7, rows[3][1]), (None, rows[5][1]), *odd_vectors(6)]
    got = centroids.cluster(vectors_of(spark, rows), dims=6, clusters=9, rounds=4, pivots=3).collect()
    want, mids = plain_clusters(rows, 6, 9, 4)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert all(r.centroid == mids[r.cluster] for r in got)
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, mids[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_and_none(spark):
    few = centroids.cluster(vectors_of(spark, random_vectors(3, 4)), dims=4, clusters=40).collect()
    assert sorted(r.distance for r in few) == [0, 0, 0]
    same = centroids.cluster(vectors_of(spark, [(i, [0.5] * 4) for i in range(10)]), dims=4, clusters=3).collect()
    assert {(r.cluster, r.distance) for r in same} == {(0, 0)}
    none = centroids.cluster(vectors_of(spark, odd_vectors(4)), dims=4)
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]
    assert centroids.cluster(vectors_of(spark, []), dims=4).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(vectors_of(spark, [(1, [1e9] * 4)]), dims=4).collect()


def test_bounds_rule_out_most_centroids():
    rng = np.random.default_rng(3)
    mids = rng.integers(-2000, 2000, (40, 8))
    x = mids[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8))
    pivots = centroids.farthest_first(x[:200], 16)
    now = centroids.Centroids.of(mids, pivots)
    number, best = now.nearest(x, centroids.distances(x, pivots))
    every = ((x[:, None, :] - mids[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


# Whitening ------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "wanted"), [(1, 3), (5, 32), (64, 32), (90, 4)])
def test_eigenvectors(dims, wanted):
    x = np.random.default_rng(dims).normal(size=(400, dims)) * np.linspace(1, 3, dims)
    x -= x.mean(axis=0)
    v = x.T @ x / len(x)
    e, u = whitening.jacobi_davidson(lambda b: x.T @ (x @ b) / len(x), dims, wanted)
    k = min(dims, wanted)
    assert e.shape == (k,) and np.allclose(e, np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-12)
    assert np.abs(v @ u - u * e).max() < 1e-12 * e[0]
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12


def test_equal_eigenvalues_and_inner_solver():
    v = np.diag([5.0] * 10 + [1.0] * 30)
    e, u = whitening.jacobi_davidson(lambda b: v @ b, 40, 15)
    assert np.allclose(e, [5.0] * 10 + [1.0] * 5) and np.abs(v @ u - u * e).max() < 1e-12
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    a = q @ np.diag(np.linspace(1, 4, 30)) @ q.T
    right, shifts = rng.normal(size=(30, 3)), np.array([0.5, 2.3, 6.0])
    t = whitening.minres(lambda b: a @ b, right, shifts, lambda x: x, 60)
    assert np.abs(a @ t - shifts * t - right).max() < 1e-8


def test_whitening_equals_a_dense_version(spark):
    rows = [*random_vectors(300, 6), *odd_vectors(6), (5, [0.25] * 6), (None, [0.5] * 6), (950, [1.0] * 5)]
    got = whitening.whiten(vectors_of(spark, rows), components=4).toPandas()
    kept = [(i, v) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)).astype(int) + 1_000_000
    n = len(x)
    y = (n * x - x.sum(axis=0)) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    assert len(got) == 4 * n and set(got.n) == {n}
    white = y @ (u / np.sqrt(e))
    for c in range(4):
        own = got[got.component == c + 1]
        want = sorted(white[:, c])
        mine = sorted(own.whitened)
        assert np.allclose(mine, want, atol=1e-9) or np.allclose(mine, sorted(-white[:, c]), atol=1e-9)
        assert np.allclose(own.explained, e[c] / np.trace(y.T @ y / n), rtol=1e-12)
    assert sorted(got[got.component == 1].deviation) == sorted(((n * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist())
    assert got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1


def test_whitening_of_flat_and_none(spark):
    flat = [(i, [float(i), 2.0, 2.0 * i]) for i in range(20)]
    assert whitening.whiten(vectors_of(spark, flat)).select("component").distinct().count() == 1
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors_of(spark, odd_vectors(3))).count() == 0
    assert whitening.whiten(vectors_of(spark, [])).count() == 0


# Suffix arrays ----------------------------------------------------------------


def plain_dedup(rows, size=suffixes.SIZE):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: math.inf if i is None else i
    for i, b in data:
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            least[s] = min(least.get(s, math.inf), rank(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if least[b[p : p + size]] < rank(i):
                gone[p : p + size] = b"\1" * size
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def same_as_plain(found, rows):
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found.collect()]
    assert sorted(got, key=str) == plain_dedup(rows)
    assert all(len(r[3]) == n for r, n in zip(sorted(got, key=str), [len(x[3]) for x in plain_dedup(rows)], strict=True))


def copied_texts(rng, n=120):
    def words(k):
        return " ".join("".join(rng.choices("abcdé", k=rng.randrange(2, 9))) for _ in range(k))

    rows = [(i, words(rng.choice([1, 5, 12, 40, 200]))) for i in range(n)]
    passages = [words(k) for k in (10, 14, 25)]
    for i in range(n, 3 * n):
        kind = rng.randrange(5)
        text = rows[rng.randrange(n)][1]
        if kind == 0:
            rows.append((i, text))
        elif kind == 1:
            at = rng.randrange(len(text))
            rows.append((i, text[:at] + "#" + text[at + 1 :]))
        elif kind == 2:
            rows.append((i, words(6) + passages[rng.randrange(3)] + words(6)))
        elif kind == 3:
            at = rng.randrange(len(text))
            rows.append((i, words(3) + text[at : at + rng.randrange(40, 60)] + words(3)))
        else:
            rows.append((i, passages[0] * rng.randrange(1, 4)))
    return rows


def test_removed_bytes_equal_brute_force(spark, docs):
    rng = random.Random(11)
    rows = copied_texts(rng)
    rows += [(1000, None), (1001, ""), (1002, "short"), (1003, "=" * 400), (1004, "=" * 49), (1005, "=" * 50), (1006, "\0" * 120), (1007, "\0" * 60)]
    rows += [(3, rows[2][1]), (3, rows[2][1]), (None, rows[1][1]), (None, "only here " * 9), (None, "only here " * 9)]
    same_as_plain(suffixes.dedup(docs(rows).withColumn("kept", F.lit(1)).withColumn("block", F.lit("x"))), rows)


def test_hot_anchors_and_many_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 20)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 6_000)
    monkeypatch.setattr(suffixes, "PART_PIECES", 20_000)
    monkeypatch.setattr(suffixes, "PART_TEXT", 30_000)
    rows = copied_texts(random.Random(12), 80)
    same_as_plain(suffixes.dedup(docs(rows).repartition(5)), rows)


def test_a_long_text(spark, docs):
    rng = random.Random(4)
    body = "".join(rng.choices("abcdefghij ", k=150_000))
    rows = [(1, body[70_000:70_300]), (2, body), (3, body[:40_000] + "!" + body[40_000:])]
    found = {r.doc_id: r for r in suffixes.dedup(docs(rows)).collect()}
    assert found[1].n_removed == 0
    assert [tuple(s) for s in found[2].spans] == [(70_000, 70_300)]
    assert bytes(found[3].kept) == b"!"


def test_empty_table(docs):
    assert suffixes.dedup(docs([])).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    body = np.concatenate([rng.integers(97, 99, 600), np.full(200, 97), rng.integers(97, 99, 300)]).astype(np.uint8)
    words = np.concatenate([body, np.zeros(7, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        words = words[:-width] << np.uint64(8 * width) | words[width:]
    order = suffixes.suffix_array(words)
    text = bytes(body) + bytes(80)
    cut = [text[p : p + suffixes.DEPTH] for p in order]
    assert cut == sorted(cut) and sorted(order) == list(range(len(body)))
    shared = suffixes.common_prefixes(words, order, np.arange(0, len(body) + 1, 50))

    def prefix(a, b):
        return next((k for k in range(suffixes.DEPTH) if a[k] != b[k]), suffixes.DEPTH)

    assert list(shared[1:]) == [prefix(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def test_shards_merge_by_binary_search():
    rng = random.Random(8)
    base = [bytes(rng.choices(b"ab", k=70)) for _ in range(6)]
    pieces = sorted({b"".join([p[: rng.randrange(50, 71)]]) for p in base for _ in range(8)})
    doc = np.array([rng.randrange(100) for _ in pieces])
    body = np.frombuffer(b"".join(pieces), np.uint8)
    bounds = np.cumsum([0, *map(len, pieces)])
    key = np.sort(np.array([i % 3 for i in range(len(pieces))], np.uint64))
    key[:] = 5
    whole = suffixes.least_documents(body, bounds, key, doc)
    cut = suffixes.least_documents(body, bounds, key, doc, limit=150)
    least = {}
    for p, d in zip(pieces, doc, strict=True):
        for i in range(len(p) - 49):
            least[p[i : i + 50]] = min(least.get(p[i : i + 50], 10**9), d)
    want = [least[p[i : i + 50]] for p in pieces for i in range(len(p) - 49)]
    assert list(whole) == want == list(cut)
