"""Annulus clustering against every distance in plain Python."""

import hashlib
import math
import random

import numpy as np

from recordlens.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, q int"


def model(rows, clusters=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:clusters]
    cents = [q for _, q in start]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [min((dist(q, c), k) for k, c in enumerate(cents)) for _, q in kept] if cents else []
        if n < rounds:
            for k in range(len(cents)):
                mine = [q for (_, q), (_, c) in zip(kept, at, strict=True) if c == k]
                if mine:
                    cents[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    sums = {}
    for d, k in at:
        sums[k] = sums.get(k, 0) + d
    return sorted((str(i), k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, at, strict=True))


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **kw).collect())


def test_clusters_are_those_of_every_distance(spark):
    rng = random.Random(3)
    vec = lambda s: [float(np.float32(rng.gauss(0, s))) for _ in range(64)]
    rows = [(i, vec(rng.choice([0.02, 0.2, 3.0]))) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(900, 940)] + [(7, rows[8][1]), (7, rows[8][1]), (None, vec(1.0))]
    odd = [(1000, None), (1001, []), (1002, [0.1] * 63), (1003, [0.1] * 63 + [None]), (1004, [float("nan")] * 64), (1005, [float("inf")] * 64), (1006, [1e30] * 64)]
    assert found(spark, rows + odd) == model(rows + odd[:-1])


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4 - 2), float(i % 3)]) for i in range(60)]
    assert found(spark, rows, dims=2, scale=1, clusters=7) == model(rows, 7, 3, 2, 1)


def test_few_and_no_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []
    rows = [(i, [0.5 * i] * 64) for i in range(3)]
    assert found(spark, rows) == model(rows)


def test_border_of_the_annulus_and_large_numbers_are_exact():
    rng = np.random.default_rng(1)
    for size in (3, 1 << 20, 1 << 26):
        c = rng.integers(-size, size, (9, 4))
        c[4] = -c[3]
        x = np.concatenate([rng.integers(-size, size, (400, 4)), (c[:4] + c[4:8]) // 2, c, np.zeros((1, 4), np.int64)])
        number, best, compared = centroids.Annulus(c).nearest(x)
        for row, n, d in zip(x.tolist(), number.tolist(), best.tolist(), strict=True):
            assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(row, k, strict=True)), j) for j, k in enumerate(c.tolist()))
    rings = np.array([[r, 0] for r in (0, 10, 20, 30, 1000)])
    assert (centroids.Annulus(rings).nearest(np.array([[21, 0], [999, 0]]))[2] <= 2).all()
