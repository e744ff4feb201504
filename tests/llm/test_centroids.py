"""Centroid clustering against the plain algorithm."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.llm import centroids as K

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k, rounds, size):
    kept = [(i, [max(min(math.floor(1024 * float(np.float32(x))), K.MOST), -K.MOST) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min(range(len(centres)), key=lambda j: (gap(v, centres[j]), j)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    d = [gap(v, centres[a]) for (_, v), a in zip(kept, at)]
    of = lambda j: sum(x for x, a in zip(d, at) if a == j)
    return sorted(
        ((i if i is not None else -1), a, x, of(a), sum(d), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d)
    )


def got_of(df, k, rounds, size):
    return sorted(((r.vec_id if r.vec_id is not None else -1), *tuple(r)[1:]) for r in K.clustered(df, k, rounds, size).collect())


def test_gain_bounds_every_point():
    r = np.random.default_rng(1)
    tight = 0
    for _ in range(300):
        centre, old = r.normal(size=(2, 6)) * 3
        new, radius = old + r.normal(size=6) * r.uniform(0.01, 2), r.uniform(0.1, 4)
        step = r.normal(size=(4000, 6))
        x = centre + radius * step / np.linalg.norm(step, axis=1, keepdims=True) * r.uniform(0, 1, (4000, 1)) ** 0.1
        most = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        bound, drift = K.farthest_gain(centre, radius, old, new), np.linalg.norm(new - old)
        assert most <= bound + 1e-9 <= drift + 2e-9
        tight += bound < 0.9 * drift
    assert tight > 100


@pytest.mark.parametrize("again", [0.25, 2.0])
def test_clusters(spark, monkeypatch, again):
    monkeypatch.setattr(K, "AGAIN", again)  # 2.0: one anchor for all rounds
    r = random.Random(5)
    middles = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [m + r.gauss(0, 0.2) for m in r.choice(middles)]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0] * 5), (1002, [1.0] * 5 + [None]), (1003, [1.0] * 5 + [float("nan")]), (1004, [1.0] * 5 + [float("inf")]), (None, [0.5] * 6)]
    rows += [(7, rows[7][1])] * 60 + [(2000, [1e9, -1e9, 0.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("v", "cluster", "own", "other", "h")})
    assert got_of(df, 8, 10, 6) == plain(rows, 8, 10, 6)


def test_bounds_spare_most_vectors(spark):
    r = np.random.default_rng(2)
    v = (r.normal(size=(8, 16)) * 2)[r.integers(0, 8, 4000)] + r.normal(size=(4000, 16)) * 0.3
    whole = np.floor(v * 1024).astype(np.int64)
    centres = np.stack([whole[np.argmin(((v - c) ** 2).sum(1))] for c in (r.normal(size=(8, 16)) * 2)])
    moved = centres + r.integers(-40, 40, centres.shape)
    d = K.squared(whole, centres)
    own, other = np.sqrt(np.sort(d, axis=1)[:, :2].astype(float)).T
    cluster = d.argmin(axis=1)
    grown, fallen = K.loosened(centres, np.array([own[cluster == j].max(initial=0) for j in range(8)]), moved)
    safe = own + grown[cluster] < other - fallen[cluster]
    assert (K.squared(whole, moved).argmin(axis=1) == cluster)[safe].all()
    drift = np.linalg.norm(moved - centres, axis=1).max()
    assert safe.sum() >= (own + grown[cluster] < other - drift).sum() > 0


def test_few_vectors_ties_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])]
    assert got_of(spark.createDataFrame(rows, SCHEMA), 8, 3, 2) == plain(rows, 8, 3, 2)
    assert got_of(spark.createDataFrame(rows, SCHEMA), 2, 0, 2) == plain(rows, 2, 0, 2)
    assert got_of(spark.createDataFrame([], SCHEMA), 8, 10, 2) == []
    assert got_of(spark.createDataFrame([(1, None)], SCHEMA), 8, 10, 2) == []
