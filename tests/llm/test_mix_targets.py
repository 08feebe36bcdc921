import warnings

import pytest

from recordlens.llm import mixing
from recordlens.llm.common import hash_bound


@pytest.fixture
def corpus(spark):
    kinds = {"good": "alpha beta gamma", "plain": "delta eps zeta", "toxic": "kappa lambda mu"}
    rows = [(i, d, f"{kinds[d]} word{i % 7} common text") for i, d in enumerate(list(kinds) * 40)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, d) for i, d, _ in rows], "doc_id long, domain string")


def test_registered_mixture_wants_no_toxic_tokens():
    assert mixing.WEIGHTS == {"good": 0.97, "plain": 0.03, "toxic": 0.0}


def test_missed_target_is_told_with_figures(corpus):
    with pytest.warns(UserWarning, match=r"targets out of reach, \d+ steps taken; expected tokens: good \d+ of \d+, plain \d+ of \d+, toxic \d+ of 0"):
        mixing.rates(*corpus, mixing.WEIGHTS)


def test_met_target_is_not(corpus):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.rates(*corpus, {"good": 0.4, "plain": 0.3, "toxic": 0.3})


def test_reached_totals_are_columns(corpus):
    with pytest.warns(UserWarning):
        got = mixing.rates(*corpus, mixing.WEIGHTS).collect()
    totals = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got) for d in mixing.WEIGHTS}
    assert {r["targets_met"] for r in got} == {False}
    for d in mixing.WEIGHTS:
        assert got[0][f"reached_{d}"] == pytest.approx(totals[d], rel=1e-9, abs=1e-6)
    assert got[0]["target_toxic"] == 0.0 and got[0]["reached_toxic"] > 0


def test_samples_are_picked_at_any_number_of_rows():
    for rows in (1e5, 7e9, 1e11, 1e14):
        bound = hash_bound(20_000 / rows)
        assert (bound + 2**63) / 2**64 == pytest.approx(20_000 / rows, rel=1e-4)
    assert hash_bound(1.0) is None and hash_bound(0.0) == -(2**63)


def model_posteriors(docs, labelled, domains):
    """The classifier in plain Python, from the hashed features that Spark gives."""
    import math

    known = dict(labelled)
    of = {d: [set(f) for i, _, f in docs if known.get(i) == d] for d in domains}
    sizes = [len(of[d]) for d in domains]
    counts = {}
    for k, d in enumerate(domains):
        for found in of[d]:
            for f in found - {mixing.ROW}:
                counts.setdefault(f, [0] * len(domains))[k] += 1
    model = {}
    for f, n in counts.items():
        overall = (sum(n) + 0.5) / (sum(sizes) + 1)
        if any(abs(c - s * overall) / math.sqrt(s * overall + 1) > mixing.DEVIATIONS for c, s in zip(n, sizes, strict=True)):
            w = [math.log((c + mixing.SMOOTHING * overall) / ((s + mixing.SMOOTHING) * overall)) for c, s in zip(n, sizes, strict=True)]
            if max(w) - min(w) >= mixing.EFFECT:
                model[f] = w
    out = {}
    for i, _, found in docs:
        told = [model[f] for f in found if f in model]
        z = [math.log((s + 1) / (sum(sizes) + len(domains))) + sum(w[k] for w in told) * math.sqrt(mixing.EVIDENCE / max(mixing.EVIDENCE, len(told))) for k, s in enumerate(sizes)]
        e = [math.exp(x - max(z)) for x in z]
        out[i] = [x / sum(e) for x in e]
    return out


def test_posteriors_and_rates_match_plain_python(spark):
    import random

    import numpy as np

    rng = random.Random(8)
    vocab = {"good": "alpha beta gamma common shared", "plain": "one two three common shared", "toxic": "bad worse vile common shared"}
    domains = list(vocab)
    rows = [(i, d, " ".join(rng.choice(((vocab[d] + " ") * 9 + vocab[rng.choice(domains)]).split()) for _ in range(rng.randrange(3, 12)))) for i, d in enumerate(domains * 200)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labelled = [(i, d) for i, d, _ in rows if i % 5]
    features = [tuple(r) for r in docs.select("doc_id", "text", mixing._buckets(docs["text"])).collect()]
    weights = {"good": 0.5, "plain": 0.3, "toxic": 0.2}
    got = {r["doc_id"]: r for r in mixing.rates(docs, spark.createDataFrame(labelled, "doc_id long, domain string"), weights).collect()}
    want = model_posteriors(features, labelled, domains)
    for i, p in want.items():
        assert all(abs(got[i][f"p_{d}"] - x) <= 1 / mixing.GRID for d, x in zip(domains, p, strict=True))
    # The least-squares solution nearest to rates of 1 from the posteriors that were returned: met, in the form of its conditions.
    p = np.array([[got[i][f"p_{d}"] for d in domains] for i in sorted(got)])
    tokens = np.array([got[i]["tokens"] for i in sorted(got)], float)
    share = np.array(list(weights.values()))
    target = share * (p.T @ tokens)[0] / share[0]
    r = np.array([got[i]["rate"] for i in sorted(got)])
    assert np.linalg.norm(p.T @ (tokens * r) - target) <= mixing.CLOSE * target.sum()
    free = r > 1e-9
    l = np.linalg.lstsq(p[free], 1 - r[free], rcond=None)[0]  # noqa: E741
    assert np.allclose(r, np.maximum(0, 1 - p @ l), atol=1e-6)


def plain_solution(p, tokens, target, steps=200_000):
    """The totals of least squares by accelerated projected gradient steps on the rates themselves."""
    import numpy as np

    a = (p * tokens[:, None]).T
    r = v = np.ones(len(p))
    bound, t = np.linalg.norm(a, 2) ** 2, 1.0
    for _ in range(steps):
        new = np.maximum(0, v - a.T @ (a @ v - target) / bound)
        if (v - new) @ (new - r) > 0:
            t = 1.0
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        r, v, t = new, new + (t - 1) / after * (new - r), after
    return a @ r


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_is_least_squares(spark, seed):
    """Targets in and out of reach: the totals are as near as a plain solver's, and no further from it than the bound says."""
    import numpy as np

    rng = np.random.default_rng(seed)
    p = np.round(rng.dirichlet([2.0, 1.0, 0.7], 60) * mixing.GRID) / mixing.GRID
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    tokens = rng.integers(1, 500, 60).astype(float)
    rows = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    for weights in ([0.97, 0.03, 0.0], [0.05, 0.05, 0.9], [0.5, 0.3, 0.2]):
        rate, figures = mixing.fit(rows, weights)
        got = rows.select("tokens", "p", rate.alias("r")).collect()
        totals = sum(np.array(x["p"]) * x["tokens"] * x["r"] for x in got)
        assert np.allclose(totals, figures["reached"]) and min(x["r"] for x in got) >= 0
        target = np.array(figures["targets"])
        best = plain_solution(p, tokens, target, 20_000)
        assert np.linalg.norm(totals - target) <= np.linalg.norm(best - target) + 1e-3 * target.sum()
        assert np.linalg.norm(totals - best) <= figures["bound"] + 1e-3 * target.sum()
        loose = mixing.fit(rows, weights, stay=0.03)[1]
        assert np.linalg.norm(np.array(loose["reached"]) - target) >= np.linalg.norm(best - target) - 1e-3 * target.sum()


def test_long_texts_and_clashing_names(corpus, spark):
    docs, labelled = corpus
    more = spark.createDataFrame([(9999, "alpha beta " * 100_000)], "doc_id long, text string")
    docs = docs.unionByName(more).selectExpr("*", "'x' as p", "1 as tokens", "2 as copies", "3 as __copies")
    out = mixing.mix(docs, labelled, {"good": 0.4, "plain": 0.3, "toxic": 0.3})
    assert out.columns == docs.columns and out.where("p = 'x' and tokens = 1 and copies = 2").count() == out.count() > 0
