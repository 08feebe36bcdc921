import random

import numpy as np
import pytest
import xxhash

from recordlens.llm import simhash
from recordlens.llm.components import components


def model_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        out |= (2 * ones > len(grams)) << bit
    return out


def model_components(rows):
    fps = [model_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, format(f, "016x"), min((x for x in groups[find(i)] if x is not None), default=None)) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))]


def corpus(rng, n=120):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.5:
            text = list((rng.choice(rows)[1] or "").split())
            if text and rng.random() < 0.7:
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 80]))]
        rows.append((d * 3 + 1, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [*corpus(rng), (2, None), (5, ""), (8, " \t\n"), (1, "w1 w2"), (1, "w1 w2"), (None, "alone " * 9), (None, None), (900, "É é A a")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, d, "x", 0) for d, t in rows], "text string, doc_id long, fp string, component_id int")
    got = [tuple(r)[:3] for r in simhash.simhash_components(df).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(model_components(rows), key=key)


def test_long_texts_are_read_in_blocks():
    rng = random.Random(3)
    text = " \n".join(f"w{rng.randrange(500)}" for _ in range(3000)).encode()
    whole = simhash.fingerprint(text)
    blocks = list(simhash.word_blocks(text, 100))
    assert [w for b in blocks for w in b] == text.split() and len(blocks) > 50
    old, simhash.BLOCK = simhash.BLOCK, 64
    assert simhash.fingerprint(text) == whole == model_fingerprint(text.decode())
    simhash.BLOCK = old


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = int(rng.integers(0, 2**63, dtype=np.int64))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        met = False
        for k in (0, 1):
            halves = np.array([(x >> 32 * k) & (2**31 - 1) for x in (a, b)], np.uint64)
            found = [set(simhash.anchors(halves[i : i + 1])[1].tolist()) for i in (0, 1)]
            met |= bool(found[0] & found[1])
        assert met


def test_forest_connects_what_links_connect():
    fps = np.array([0, 7, 63, 0xFFFF << 40, (0xFFFF << 40) | 1], np.uint64)
    edges = simhash.forest(fps).tolist()
    assert len(edges) == 3 and {frozenset(e) for e in edges} >= {frozenset((0, 7)), frozenset((7, 63)), frozenset((0xFFFF << 40, (0xFFFF << 40) | 1))}


def connected(fps, edges):
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(int(u))] = find(int(v))
    groups = {}
    for f in root:
        groups.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_a_crowded_anchor_links_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 5), replace=False)) for b in np.repeat(base, 4)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = connected(fps, simhash.forest(fps)) if len(fps) <= simhash.CROWD else None
    brute = connected(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= 3])
    monkeypatch.setattr(simhash, "CROWD", 8)
    assert connected(fps, simhash.forest(fps)) == brute and want in (None, brute)


def test_anchors_that_span_batches():
    rows = [(5, 1), (5, 3), (7, 8), (7, 9), (7, 0xFF << 50), (9, 11), (9, 11 << 30), (12, 4)]
    import pyarrow as pa

    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], ["anchor", "fp"])
    for size in (1, 2, 3, 8):
        out = simhash._compare(3)(batch(rows[i : i + size]) for i in range(0, len(rows), size))
        assert sorted(e for b in out for e in zip(*(c.to_pylist() for c in b.columns), strict=True)) == [(1, 3), (8, 9)]


def test_a_row_without_doc_id_bridges_two_others(spark):
    fps = {"a": 0x5F9D3A9D2C58CACD, "b": 0x5F9D3A9DAC58CACD, "c": 0x4D9D3A9DAC48CACD}
    old, simhash.fingerprints = simhash.fingerprints, lambda docs, width=3: docs.sparkSession.createDataFrame([(1, 1, fps["a"]), (None, 2, fps["b"]), (2, 3, fps["c"])], "doc_id long, th long, fp long")
    try:
        assert [r["component_id"] for r in simhash.simhash_components(spark.range(1)).collect()] == [1, 1, 1]
    finally:
        simhash.fingerprints = old


def test_dedup_keeps_other_texts_of_a_repeated_doc_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    got = simhash.dedup(spark.createDataFrame([(1, a), (1, b), (1, a), (2, b)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in got) == [(1, "a"), (1, "b")]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(path + star + [(5, 5)], "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{100 + i: 100 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, "a"), (3, text, "b"), (9, "other words are here", "c"), (9, "other words are here", "c"), (None, text, "d"), (None, "nothing like it at all", "e")]
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, __stay string")).collect()
    assert sorted((r["doc_id"], r["__stay"]) for r in got if r["doc_id"] is not None) == [(3, "b"), (9, "c")]
    assert [r["__stay"] for r in got if r["doc_id"] is None] == ["e"]


def test_no_rows(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string"), threshold=4)
