"""The hidden Markov model against sums over every path of states, and its scores against plain Python."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from recordlens.llm import hmm

SCHEMA = "doc_id long, text string, word int, n string, row string"


def some_model(k=3, s=5, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((s, k)), 0))


def paths(m, doc):
    """Each path of states with its probability."""
    for z in itertools.product(range(len(m.start)), repeat=len(doc)):
        p = m.start[z[0]] * m.emits[doc[0], z[0]]
        for a, b, w in zip(z, z[1:], doc[1:], strict=False):
            p *= m.moves[a, b] * m.emits[w, b]
        yield z, p


@pytest.fixture
def docs():
    rng = np.random.default_rng(2)
    return [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 7, 2, 5, 3, 7, 1, 8, 4)]


@pytest.mark.parametrize("segment,held", [(1024, 1 << 18), (3, 4), (1, 1)])
def test_recursions_are_sums_over_paths(monkeypatch, docs, segment, held):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "HELD", held)
    m = some_model()
    start, moves, emits, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for d in docs:
        total = sum(p for _, p in paths(m, d))
        logs.append(math.log10(total))
        for z, p in paths(m, d):
            start[z[0]] += p / total
            for a, b in itertools.pairwise(z):
                moves[a, b] += p / total
            for w, a in zip(d, z, strict=True):
                emits[w, a] += p / total
    assert np.allclose(hmm.score(m, docs), logs)
    found = hmm.Expected(m)
    found.add(docs)
    assert np.allclose(found.start, start) and np.allclose(found.moves, moves) and np.allclose(found.emits, emits)


def test_long_documents_keep_their_scale():
    m, rng = some_model(4, 50, 3), np.random.default_rng(4)
    doc = rng.integers(0, 50, 40_000).astype(np.uint16)
    a, total = m.start, 0.0
    for t, w in enumerate(doc):
        a = (a @ m.moves if t else a) * m.emits[w]
        total += math.log10(a.sum())
        a = a / a.sum()
    assert hmm.score(m, [doc, doc[:9]])[0] == pytest.approx(total)
    sums = hmm.Expected(m)
    sums.add([doc, doc[:9]])
    assert sums.emits.sum() == pytest.approx(40_009) and sums.moves.sum() == pytest.approx(40_007) and sums.start.sum() == pytest.approx(2)


def test_each_round_fits_better_and_sums_to_one():
    rng = np.random.default_rng(5)
    docs = [(rng.integers(0, 20, 60) + 20 * (i % 2)).astype(np.uint16) for i in range(40)]
    unigrams = np.bincount(np.concatenate(docs), minlength=41) * 0.9
    unigrams = np.append(unigrams[:40], 240.0) / 2400
    model, last = hmm.first_model(unigrams, 2), -math.inf
    for _ in range(25):
        now = hmm.score(model, docs).sum()
        assert now > last - 1e-6
        last, sums = now, hmm.Expected(model)
        sums.add(docs)
        model = sums.model_of(unigrams, 1e-9)
        for p, axis in ((model.start, 0), (model.moves, 1), (model.emits, 0)):
            assert np.allclose(p.sum(axis=axis), 1)
    assert last > -2400 * math.log10(22)  # two kinds of document, told apart by the states


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b""]


def rows():
    rng = np.random.default_rng(6)
    words = ["the", "The", "of", "Zebra", "x" * 40, "x" * 41, "É", "é", "ab", "cd"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)] + ["a b\tc\x0bd\x0ce\r\n f", None, "", " \n", "long " * 5000]
    out = [(i, t, 1, "n", "r") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, "the of", 1, "n", "r"), (5, "another text", 1, "n", "r"), (100_000, None, 1, "n", "r")]


def test_scores_of_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(hmm, "FLUSH_WORDS", 20)
    given = rows()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in given]
    counts = Counter(w for r, h in zip(given, held, strict=True) if not h for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r, h in zip(given, held, strict=True):
        t = tokens(r[1])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        want.append((str(r[0]), h, len(t), sum(w in counts for w in t), n, round(base, 6)))
    scores = {}
    for head in (10, 65_535):
        got = hmm.score_documents(spark.createDataFrame(given, SCHEMA).repartition(3), states=2, rounds=1, head=head).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
        scores[head] = sum(r.score for r in got)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert scores[65_535] > sum(w[-1] for w in want)  # better than the unigrams


def test_one_state_gives_the_discounted_unigrams(spark):
    """With one state and words in the tail, the score is the sum of the words' own shares, seen or not."""
    given = rows()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in given]
    counts = Counter(w for r, h in zip(given, held, strict=True) if not h for w in tokens(r[1]))
    n, v, once, twice = sum(counts.values()), len(counts), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    top = sorted(counts, key=lambda w: (-counts[w], hmm.key(w)))[:6]
    u = {w: (c - d) / n for w, c in counts.items()}
    tail, in_tail = 1 - sum(u[w] for w in top), n - sum(counts[w] for w in top)
    off = sum(min(d, counts[w]) for w in top) + min(d, in_tail)
    emit = {w: (counts[w] - d + off * u[w]) / n for w in top}
    rest = (in_tail - min(d, in_tail) + off * tail) / n
    p = lambda w: emit[w] if w in emit else rest * u.get(w, d * v / n) / tail
    assert sum(map(p, counts)) + p(b"never seen") == pytest.approx(1)
    got = hmm.score_documents(spark.createDataFrame(given, SCHEMA), states=1, rounds=1, head=6).collect()
    assert sorted(round(r.score, 4) for r in got) == sorted(round(sum(math.log10(p(w)) for w in tokens(r[1])), 4) for r in given)


def test_nothing_to_train_on(spark):
    assert hmm.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    (i,) = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    got = hmm.score_documents(spark.createDataFrame([(i, "only held out", 1, "n", "r")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(i, True, 4, 0, 0, 0.0, 0.0)]
