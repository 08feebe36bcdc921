"""Components and reachable sets against plain Python and against the closures by frontiers."""

import random

import pytest

from recordlens.operators import graph, reach


def led(edges, start):
    seen, stack = {start}, [start]
    while stack:
        at = stack.pop()
        new = {d for s, d in edges if s == at} - seen
        seen |= new
        stack += new
    return seen


@pytest.mark.parametrize("seed,nodes,links", [(1, 12, 14), (3, 25, 20)])
def test_components_and_sets(spark, seed, nodes, links):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)] + [(3, 3), (None, 1), (1, None)] + [(100, 101), (101, 102), (102, 100), (102, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    ids = {x for e in edges if None not in e for x in e}
    reached = {i: led([e for e in edges if None not in e], i) for i in ids}
    want = {i: min(j for j in reached[i] if i in reached[j]) for i in ids}
    assert {r.id: r.component for r in reach.components(df).collect()} == want
    seeds = spark.createDataFrame([(i,) for i in sorted(ids)[::2]] + [(999,), (None,), (100,), (100,)], "id long")
    got = sorted(map(tuple, reach.Reach(df).of_seeds(seeds).collect()))
    assert got == sorted((s, i) for s in {*sorted(ids)[::2], 999, 100} for i in reached.get(s, {s}))
    if seed == 1:
        assert got == sorted(map(tuple, graph.closure_by_seed(seeds.distinct(), df).collect()))


def test_no_edges_and_texts(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert reach.Reach(none).of_seeds(spark.createDataFrame([("a",)], "id string")).collect() == [("a", "a")]
    some = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert sorted(map(tuple, reach.Reach(some).of_seeds(spark.createDataFrame([("a",)], "id string")).collect())) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_nodes_that_nothing_leads_to_have_no_set(spark):
    """Many leaves above a few shared nodes: the shared ones alone are bitmaps, and the leaves reach the same."""
    edges = [(f"c{i}", f"n{i % 3}") for i in range(60)] + [("n0", "r"), ("n1", "n2"), ("n2", "n1")]
    of = reach.Reach(spark.createDataFrame(edges, "src string, dst string"))
    assert of.sets.select("n").distinct().count() == 3  # n0, r and the cycle
    got = sorted(map(tuple, of.of_seeds(spark.createDataFrame([("c0",), ("c1",), ("n0",), ("x",)], "id string")).collect()))
    assert got == [("c0", "c0"), ("c0", "n0"), ("c0", "r"), ("c1", "c1"), ("c1", "n1"), ("c1", "n2"), ("n0", "n0"), ("n0", "r"), ("x", "x")]
