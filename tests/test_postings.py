"""Lexical search by postings against every score in plain Python."""

import random
import re

import pytest

from recordlens.operators import postings

WORD = re.compile(r"[A-Za-z0-9_.:/=-]+")


def model(queries, records, k):
    out = []
    for q, query in queries:
        low = (query or "").lower()
        asked = {t for t in WORD.findall(low) if len(t) > 2}
        scores = []
        for r, body in records:
            text = (body or "").lower()
            scores.append((-(2 * len(asked & set(WORD.findall(text))) + (low in text)), r))
        out += [(q, n + 1, r, -s) for n, (s, r) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(n, words, seed, longest=30):
    rng = random.Random(seed)
    pick = lambda: words[min(int(rng.expovariate(0.15)), len(words) - 1)]
    return [(i, rng.choice([" ", ", ", "  "]).join(pick() for _ in range(rng.randrange(longest)))) for i in range(n)]


def found(spark, queries, records, k):
    q = spark.createDataFrame(queries, "query_id int, query string")
    r = spark.createDataFrame(records, "record_id int, body string").repartition(3)
    return sorted(map(tuple, postings.lexical_topk(q, r, k).collect()))


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 1), (3, 40)])
def test_equal_to_every_score(spark, seed, k):
    words = ["the", "of", "Alpha", "ab", "x", "be-ta", "gam.ma", "äöü", "c:d", *(f"w{i}" for i in range(40))]
    records = rows(60, words, seed) + [(900, None), (901, ""), (902, "the the the"), (903, "concatenated äö")]
    queries = rows(25, words, seed + 50, 12) + [(100, None), (101, ""), (102, "cat"), (103, "äö"), (104, "no such words"), (105, "the of"), (106, "be-ta gam.ma alpha"), (107, records[3][1]), (108, "the")]
    assert found(spark, queries, records, k) == model(queries, records, k)


def test_few_records_and_none(spark):
    queries = [(1, "alpha beta"), (2, "zz")]
    assert found(spark, queries, [(1, "alpha")], 3) == model(queries, [(1, "alpha")], 3)
    assert found(spark, queries, [], 3) == [] and found(spark, [], [(1, "a")], 3) == []


def test_blocks_of_phrases(spark, monkeypatch):
    monkeypatch.setattr(postings, "PHRASES", 2)
    records, queries = [(i, "é" * i) for i in range(9)], [(i, "é" * i) for i in range(7)]
    assert found(spark, queries, records, 3) == model(queries, records, 3)


def test_ids_are_keys(spark):
    records = [(1, "alpha"), (1, "beta gamma delta"), (None, "alpha beta"), (2, "beta")]
    assert found(spark, [(7, "alpha beta"), (None, "x")], records, 2) == [(7, 1, 1, 4), (7, 2, 2, 2)]


def test_few_records_are_scored(spark):
    """A passage that some records hold: the frequent words that all share lead to no scoring."""
    rng = random.Random(4)
    common = [f"common{i}" for i in range(20)]
    records = [(i, " ".join(rng.sample(common, 12) + [f"rare{rng.randrange(3000)}" for _ in range(6)])) for i in range(400)]
    passage = " ".join(common[:10] + [f"rare{9000 + i}" for i in range(8)])
    records += [(1000 + i, passage + f" tail{i}") for i in range(5)]
    q, r = spark.createDataFrame([(1, passage)], "query_id int, query string"), spark.createDataFrame(records, "record_id int, body string")
    (row,) = postings.scored_report(q, r, 5).collect()
    assert row.sharing == 405 and row.scored == 5
    assert [x.record_id for x in postings.lexical_topk(q, r, 5).orderBy("rank").collect()] == [1000 + i for i in range(5)]


def test_bound_does_not_depend_on_the_smallest_ids(spark):
    """Records that share most come late and have no rare words: the bound still finds them, so few of the others are scored."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(10)]
    records = [(i, " ".join(rng.sample(words, 3))) for i in range(3000)] + [(5000 + i, " ".join(words[::-1])) for i in range(200)]
    query = " ".join(words)
    q, r = spark.createDataFrame([(1, query)], "query_id int, query string"), spark.createDataFrame(records, "record_id int, body string")
    (row,) = postings.scored_report(q, r, 5).collect()
    assert row.sharing == 3200 and 200 <= row.scored < 1600
    assert found(spark, [(1, query)], records, 5) == model([(1, query)], records, 5)


def test_phrases_decide_between_equal_counts(spark):
    """Texts are read only for pairs that tie with the k-th; short tokens and ids that repeat are in the middle of it."""
    records = [(i, "gamma beta of alpha") for i in range(20)] + [(30 + i, "x alpha of beta gamma y") for i in range(3)] + [(40, "alpha of"), (40, "beta gamma"), (41, "alpha beta")]
    queries = [(1, "Alpha of beta gamma"), (2, "alpha of"), (3, "of"), (4, "beta gamma y"), (5, "of beta")]
    q, r = spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(records, "record_id int, body string")
    got = {(x.query_id, x["rank"]): (x.record_id, x.score) for x in postings.lexical_topk(q, r, 4).collect()}
    merged = [x for x in records if x[0] != 40] + [(40, "alpha of\nbeta gamma")]
    assert got == {(a, b): (c, d) for a, b, c, d in model(queries, merged, 4)}
