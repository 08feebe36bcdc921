"""Open intervals against a sweep in plain Python."""

import math
import random
from datetime import datetime, timedelta

import pytest

from recordlens.llm import concurrency

SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, nation_id int, end string"
LINES = "sale_id long, shipped_at timestamp_ntz, chunk int"
CLIENTS = "client_id long, nation_id int, total string"
ZERO = datetime(1970, 1, 1)


def model(sales, lines, clients):
    second = lambda t: math.floor((t - ZERO) / timedelta(microseconds=1)) // 1_000_000
    ends, home, moves = {}, {}, {}
    for s, at in lines:
        if s is not None and at is not None:
            ends[s] = min(ends.get(s, math.inf), second(at) + 86400)
    for c, n in clients:
        if c is not None and n is not None:
            home[c] = min(home.get(c, math.inf), n)
    for s, c, total, at in sales:
        if at is None or (end := ends.get(s, math.inf)) <= second(at):
            continue
        cents = math.floor(100 * total + 0.5) if total is not None and math.isfinite(total) else 0
        for nation in (home.get(c, -1), -2):
            for t, n in ((second(at), 1), (end, -1)):
                if t < math.inf:
                    dn, dc = moves.setdefault(nation, {}).get(t, (0, 0))
                    moves[nation][t] = dn + n, dc + n * cents
    out = []
    for nation, own in moves.items():
        n = c = high = 0
        rows = []
        times = sorted(t for t, d in own.items() if d != (0, 0))
        for t, then in zip(times, [*times[1:], None], strict=True):
            n, c = n + own[t][0], c + own[t][1]
            high = n if not rows else max(high, n)
            rows.append((nation, t, then, n, c, high))
        peak = max((r[4] for r in rows), default=None)
        out += [(*r, r[4] == peak) for r in rows]
    return sorted(out)


def found(spark, sales, lines, clients):
    frames = [
        spark.createDataFrame([(*r, 3, "x") for r in sales], SALES),
        spark.createDataFrame([(*r, 1) for r in lines], LINES),
        spark.createDataFrame([(*r, "t") for r in clients], CLIENTS),
    ]
    return sorted(tuple(r) for r in concurrency.concurrency(*frames).collect())


@pytest.mark.parametrize("bits", [(16, 10), (3, 2)])
def test_sweep_is_that_of_plain_python(spark, monkeypatch, bits):
    """With narrow chunks the carries pass through every level of the scan."""
    monkeypatch.setattr(concurrency, "CHUNK_BITS", bits[0])
    monkeypatch.setattr(concurrency, "FAN_BITS", bits[1])
    rng = random.Random(5)
    at = lambda span: datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(span), microseconds=rng.choice([0, 999_999]))
    sales = [(rng.choice([7, i]), rng.choice([1, 1, rng.randrange(9), None]), rng.choice([None, rng.random() * 50, 0.005, 3.0]), rng.choice([at(400), at(90_000), None])) for i in range(150)]
    lines = [(rng.randrange(160), rng.choice([at(200), None, datetime(2024, 1, 1)])) for _ in range(200)] + [(7, datetime(2024, 1, 1, 0, 2))] * 40 + [(None, datetime(2024, 1, 1))]
    clients = [(i, rng.choice([None, i % 3, 0])) for i in range(7)] + [(1, 2), (None, 1)]
    if bits[0] == 3:  # a few hundred seconds only
        sales, lines = [s for s in sales if s[3] is None or s[3] < datetime(2024, 1, 1, 0, 7)], [(s, t and t - timedelta(days=1)) for s, t in lines]
    got = found(spark, sales, lines, clients)
    assert got == model(sales, lines, clients) and len(got) > 25


def test_far_times_nothing_and_what_is_no_number(spark):
    sales = [(1, 1, 1.0, datetime(1, 1, 1)), (2, 1, float("nan"), datetime(1969, 12, 31, 23, 59, 59, 500_000)), (3, 2, float("inf"), datetime(9999, 12, 31)), (4, 1, -0.005, datetime(2024, 1, 1)), (None, None, 2.5, datetime(2024, 1, 1))]
    lines = [(2, datetime(2024, 2, 30 - 1)), (4, datetime(2024, 1, 1)), (3, None)]
    assert found(spark, sales, lines, [(1, -1), (2, -2)]) == model(sales, lines, [(1, -1), (2, -2)])
    assert found(spark, [], [], []) == []
    assert found(spark, [(1, 1, 1.0, None)], [], []) == []
    # Starts and ends that cancel out are no moments.
    assert found(spark, [(1, 1, 1.0, datetime(2024, 1, 1)), (2, 1, 1.0, datetime(2024, 1, 3))], [(1, datetime(2024, 1, 2))], [(1, 4)]) == model(
        [(1, 1, 1.0, datetime(2024, 1, 1)), (2, 1, 1.0, datetime(2024, 1, 3))], [(1, datetime(2024, 1, 2))], [(1, 4)]
    )


def test_zoned_times_are_the_same_instants(spark):
    zoned = spark.sql("select 1L as sale_id, 1L as client_id, 2D as total, timestamp'2024-01-01 00:00:00+02:00' as sold_at")
    none = spark.createDataFrame([], LINES)
    rows = concurrency.concurrency(zoned, none, spark.createDataFrame([], CLIENTS)).collect()
    assert sorted(map(tuple, rows)) == [(n, 1704060000, None, 1, 200, 1, True) for n in (-2, -1)]
