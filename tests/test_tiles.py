"""Vector search by tiles against every score in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from recordlens.operators import tiles


def model(queries, vectors, k):
    sound = lambda v: v is not None and len(v) > 0 and None not in v
    out = []
    for i, q in queries:
        if sound(q):
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors if sound(v) and len(v) == len(q) and j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, queries, vectors, k):
    q, v = spark.createDataFrame(queries, "query_id int, q array<double>"), spark.createDataFrame(vectors, "vec_id long, v array<double>").repartition(3)
    return sorted(map(tuple, tiles.vector_topk(q, v, k).collect()))


def some(n, seed):
    """Vectors of halves, so that scores are exact and tie."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-4, 5) / 2 * rng.choice([1, 1, 8]) for _ in range(rng.choice([3, 3, 3, 5]))]) for i in range(n)]
    return rows + [(n, None), (n + 1, []), (n + 2, [1.0, None, 2.0]), (n + 3, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0])]


@pytest.mark.parametrize("k,small", [(3, True), (1, True), (200, True), (4, False)])
def test_equal_to_every_score(spark, monkeypatch, k, small):
    if small:
        for name, value in (("VECTORS", 17), ("QUERIES", 6), ("ROWS", 5), ("COLUMNS", 2)):
            monkeypatch.setattr(tiles, name, value)
    vectors = some(120, 1)
    queries = [(i + 100, q) for i, q in some(20, 2)][:-1] + [(7, vectors[7][1])]
    assert found(spark, queries, vectors, k) == model(queries, vectors, k)


def test_tiles_of_small_norms_are_not_scored(spark):
    rows = [(i, [float(100 - i), 0.0]) for i in range(100)]
    df = lambda r, block: tiles._blocks(spark.createDataFrame(r, "id long, v array<double>"), 10, block)
    (vectors, n), (queries, _) = df(rows, "vb"), df([(1000 + i, [1.0, 0.5]) for i in range(20)], "qb")
    needed = tiles.needed_tiles(vectors, queries, 3)
    assert n == 10 and needed.select("qb").distinct().count() == 2
    assert needed.agg(F.max("vb")).first()[0] < 3


def test_nothing(spark):
    assert found(spark, [], [(1, [1.0])], 3) == [] and found(spark, [(1, [1.0])], [], 3) == []
    assert found(spark, [(1, [float("nan"), 1.0])], [(2, [1.0, 1.0])], 3) == []
    with pytest.raises(ValueError):
        found(spark, [], [], 0)
