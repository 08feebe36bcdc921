"""Mixing to target weights by soft membership (operator 7), in DataFrame functions only.

A naive Bayes classifier over hashed words and word shapes is trained on the labelled table and gives
each document a posterior over the domains. Only features that a domain has significantly more or less
often than the labelled documents as a whole take part, if domains differ in it by EFFECT at least, so rare and weak words add no noise; and
the evidence of n of them, above EVIDENCE, grows as the root of n, since words that come together say the same
several times. Posteriors are given in steps of 1 / GRID. Rates r >= 0 for all documents are then fitted by projected
gradient steps on the squared distance of the expected token totals of the domains, sum of r * tokens * posterior, from
the targets. The steps are lazy: the gradients' numbers, one per domain, add up in l, and the projection is of the
start and their sum, r = max(0, 1 - posterior . l), so a document's rate needs these few numbers only, which are all that passes
between the tasks and the driver. A step is scaled by the inverse of the domains' moment matrix (of rows above 0)
and searched for its best length. Of all least-squares solutions the steps lead to the one that is nearest to
rates of 1: each stage adds ``stay`` * total / 2 * (sum of tokens * (r - 1) ** 2) to the square, with an ever smaller ``stay``, and a
bound on the distance to the solution comes with the result. Documents of one posterior move alike, so the steps run over
the tokens of each posterior that occurs.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import chosen, cut
from recordlens.llm.quality import words_of

#: Hashed features of the classifier: at most as many rows are broadcast, a few thousand in practice.
BUCKETS = 1 << 18
#: Labelled documents that the classifier is trained on at most, about: a share by hash of the doc_id.
MAX_LABELLED = 20_000
#: Documents' worth of the overall frequency that each domain's is smoothed with, and the deviations
#: from chance that a feature needs.
SMOOTHING, DEVIATIONS = 20.0, 3.5
#: What a feature needs besides: in one domain it is so much (a log ratio, six times) more frequent than in another.
EFFECT = 1.8
#: Features of a document that count in full; the evidence of more grows with the root of their number.
EVIDENCE = 5
#: Posteriors are multiples of 1 / GRID; sums of them are exact.
GRID = 1024
#: Targets are met within this part of the total.
CLOSE = 1e-7
#: ``stay`` of the stages of a fit; the last one leaves targets that can be met by about itself.
STAGES = [1e-4, 1e-6, 1e-8]
#: Steps of a stage at most (they end by themselves before), and the lengths of a step that are tried.
STEPS, LENGTHS = 100, [2.0**-h for h in (0, 1, 2, 3, 4, 6, 8, 10, 12)]
#: A feature of every row: it counts how often a row is repeated.
ROW = -1


def _buckets(text: Column) -> Column:
    """The distinct features of a text: words in lower case, and shapes with letters folded."""
    shapes = F.regexp_replace(F.regexp_replace(text, r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    bucket = lambda seed: lambda w: F.pmod(F.xxhash64(w, F.lit(seed)), F.lit(BUCKETS)).cast("int")
    return F.array_distinct(
        F.concat(F.array(F.lit(ROW)), F.transform(words_of(F.lower(text)), bucket("word")), F.transform(words_of(shapes), bucket("shape")))
    )


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[float]]:
    """(bucket, w: log ratios by domain) and the domains' log priors from (doc_id, domain) rows."""
    k = len(domains)
    some = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    some = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    some = some.where(chosen(max_labelled / max(some.count(), 1), "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = texts.join(F.broadcast(some), "doc_id").select("domain", F.explode(_buckets(F.col("text"))).alias("bucket"))
    counts = words.groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)))
    counts = cut(counts)
    row = counts.where(F.col("bucket") == ROW).first()
    sizes = [row[f"n{i}"] if row else 0 for i in range(k)]
    overall = (sum((F.col(f"n{i}") for i in range(k)), F.lit(0)) + 0.5) / (sum(sizes) + 1)
    counts = counts.where(F.col("bucket") != ROW).withColumn("overall", overall)
    far = [F.abs(F.col(f"n{i}") - n * F.col("overall")) / F.sqrt(n * F.col("overall") + 1) > DEVIATIONS for i, n in enumerate(sizes)]
    telling = far[0]
    for f in far[1:]:
        telling = telling | f
    logs = [F.log((F.col(f"n{i}") + SMOOTHING * F.col("overall")) / ((n + SMOOTHING) * F.col("overall"))) for i, n in enumerate(sizes)]
    model = counts.where(telling).select("bucket", F.array(*logs).alias("w")).where(F.array_max("w") - F.array_min("w") >= EFFECT)
    own = docs.sparkSession.createDataFrame([(ROW, [0.0] * k)], "bucket int, w array<double>")
    return model.unionByName(own), [math.log((n + 1) / (sum(sizes) + k)) for n in sizes]


def posteriors(docs: DataFrame, model: DataFrame, priors: list[float]) -> DataFrame:
    """(doc_id, th, tokens, p): a row per row of ``docs``, with its words as tokens and its posterior."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id", F.xxhash64("text").alias("th"), F.size(words_of(F.col("text"))).cast("long").alias("tokens"), _buckets(F.col("text")).alias("b")
        )
    )
    k = len(priors)
    words = rows.select("doc_id", "th", F.explode("b").alias("bucket")).join(F.broadcast(model), "bucket")
    sums = words.groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).agg(
        F.count_if(F.col("bucket") == ROW).alias("times"), F.count(F.lit(1)).alias("hits"), *(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k))
    )
    joined = rows.drop("b").join(sums, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th")))
    telling = F.col("hits") / F.col("times") - 1
    damped = F.when(telling > EVIDENCE, F.sqrt(EVIDENCE / telling)).otherwise(1.0)
    logits = [F.lit(priors[i]) + F.col(f"s{i}") / F.col("times") * damped for i in range(k)]
    scored = joined.select("doc_id", "th", "tokens", F.array(*logits).alias("z"))
    exps = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    scored = scored.withColumn("e", exps).withColumn("all", F.aggregate("e", F.lit(0.0), lambda a, y: a + y))
    # Rounding the running sums keeps the posteriors at 0 or more and their sum at 1.
    up_to = [F.lit(0.0), *(F.round(sum((F.col("e")[j] for j in range(i + 1)), F.lit(0.0)) / F.col("all") * GRID) / GRID for i in range(k - 1)), F.lit(1.0)]
    return scored.select("doc_id", "th", "tokens", F.array(*(b - a for a, b in zip(up_to, up_to[1:], strict=False))).alias("p"))


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivots on the few domains' equations; a tiny ridge for empty domains."""
    n = len(right)
    ridge = 1e-12 * max(1e-300, max(matrix[i][i] for i in range(n)))
    a = [[matrix[i][j] + ridge * (i == j) for j in range(n)] + [right[i]] for i in range(n)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        if a[i][i] == 0:
            continue
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def _numbers(values: list[float]) -> str:
    return "array(" + ", ".join(f"{x!r}D" for x in values) + ")"


def _dot(numbers: list[float]) -> str:
    """A posterior times a number per domain. The numbers stand in arrays, so the code of a plan is the same for all of them and compiled once."""
    return f"aggregate(zip_with(p, {_numbers(numbers)}, (x, y) -> x * y), 0D, (a, x) -> a + x)"


def fit(rows: DataFrame, weights: list[float], total: float | None = None, stay: float = 0.0) -> tuple[Column, dict]:
    """The rates for ``rows`` (tokens, p) as a column, and figures of the fit.

    ``total``: expected tokens of the mixture; by default the domain of the largest weight is used once,
    and the others as often as their weights ask for beside it. ``stay``: 0 for least squares; above, rates leave
    1 only for what is worth it: a document goes when its posterior times the domains' excess, in parts of
    the total, is ``stay``. ``met`` tells whether the targets are met, ``bound`` is a number of tokens that the totals are
    at most away from the least-squares ones: with the excess g at the totals y, the root of
    g . y + |targets| * sqrt(domains) * max(0, -min(p . g)), which is 0 at the solution only.
    """
    k = len(weights)
    share = [w / sum(weights) for w in weights]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cells = cut(rows.groupBy("p").agg(F.sum("tokens").alias("tokens")))

    def state(at: list[float], step: list[float], lengths: list[float]) -> list[tuple[list[float], list[list[float]], float]]:
        """After each length of a step: the domains' tokens, the moments of the rows whose rate is over 0, and half the tokens by squared rate."""
        tried = f"posexplode(transform({_numbers(lengths)}, h -> greatest(0D, 1D - here + h * along))) AS (h, r)"
        moved = cells.selectExpr("tokens", "p", f"{_dot(at)} AS here", f"{_dot(step)} AS along").selectExpr("tokens", "p", tried)
        names = {f"m{i}": f"tokens * r * p[{i}]" for i in range(k)} | {f"q{i}_{j}": f"CASE WHEN r > 0 THEN tokens * p[{i}] * p[{j}] END" for i, j in pairs} | {"half": "tokens * r * r / 2"}
        got = {row["h"]: row for row in moved.groupBy("h").agg(*(F.expr(f"sum({x}) AS {n}") for n, x in names.items())).collect()}
        out = []
        for h in range(len(lengths)):
            own = [float((got[h][n] if h in got else None) or 0.0) for n in names]
            matrix = [[0.0] * k for _ in range(k)]
            for (i, j), x in zip(pairs, own[k:], strict=False):
                matrix[i][j] = matrix[j][i] = x
            out.append((own[:k], matrix, own[-1]))
        return out

    l = [0.0] * k  # noqa: E741
    (now,) = state(l, l, [0.0])
    have = now[0]
    if total is None:
        largest = max(range(k), key=lambda i: share[i])
        total = have[largest] / share[largest]
    targets = [s * total for s in share]
    size, steps, bound = max(total, 1.0), 0, 0.0
    for stiff in [stay] if stay else STAGES:
        ease = stiff * size
        # What the steps make smallest; its gradient is 0 where the rates are those of the stage.
        value = lambda at, half, ease=ease: ease / 2 * sum(x * x for x in at) + sum(x * t for x, t in zip(at, targets, strict=True)) + half
        for _ in range(STEPS):
            gradient = [ease * x + t - n for x, t, n in zip(l, targets, now[0], strict=True)]
            if math.hypot(*gradient) <= 1e-9 * size:
                break
            step = _solve([[x + ease * (i == j) for j, x in enumerate(row)] for i, row in enumerate(now[1])], gradient)
            tried = state(l, step, LENGTHS)
            places = [[x - h * y for x, y in zip(l, step, strict=True)] for h in LENGTHS]
            values = [value(at, t[2]) for at, t in zip(places, tried, strict=True)]
            best = min(range(len(LENGTHS)), key=values.__getitem__)
            if values[best] >= value(l, now[2]):
                break
            l, now, steps = places[best], tried[best], steps + 1  # noqa: E741
        excess = [n - t for n, t in zip(now[0], targets, strict=True)]
        least = cells.where("tokens > 0").agg(F.expr(f"min({_dot(excess)})")).first()[0] or 0.0
        bound = math.sqrt(max(0.0, sum(g * n for g, n in zip(excess, now[0], strict=True)) + math.hypot(*targets) * math.sqrt(k) * max(0.0, -least)))
        distance = math.hypot(*excess)
        if distance <= CLOSE * size:
            break
    figures = {"have": have, "targets": targets, "reached": now[0], "steps": steps, "met": distance <= CLOSE * size, "bound": bound}
    return F.greatest(F.lit(0.0), 1.0 - F.expr(_dot(l))), figures


def _tell_miss(domains: list[str], figures: dict) -> None:
    """Warn of targets that the fit did not reach, with the tokens that it did."""
    if not figures["met"]:
        told = ", ".join(f"{d} {n:.0f} of {t:.0f}" for d, n, t in zip(domains, figures["reached"], figures["targets"], strict=True))
        warnings.warn(f"targets out of reach, {figures['steps']} steps taken; expected tokens: {told}", stacklevel=4)


def rates(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, max_labelled: int = MAX_LABELLED, stay: float = 0.0
) -> DataFrame:
    """The rate of every row of ``docs`` (doc_id, text; others are ignored) in the mixture.

    ``labelled``: (doc_id, domain); rows without either, or of other domains, are ignored. ``weights``:
    the wanted share of the expected tokens of each domain. Returns doc_id, tokens (words), p_<domain>,
    rate, copies (the rate rounded up or down by a hash of the row, so that copies average to it) and, alike in
    all rows, target_<domain> and reached_<domain> (the expected tokens wanted and got), targets_met and fit_bound (how
    many tokens the totals are at most away from the least-squares ones; see ``fit`` for it and for ``stay``). A null
    or empty text has no tokens and the posterior of the priors. Rows come back as often as they come in,
    null doc_ids too. Without labels all domains are equally likely. No rows give no rows. Targets that are
    out of reach are also told as a warning.
    """
    return _rates(docs, labelled, weights, total, max_labelled, stay).drop("th")


def _rates(docs, labelled, weights, total, max_labelled, stay):
    domains = list(weights)
    model, priors = train(docs, labelled, domains, max_labelled)
    rows = cut(posteriors(docs, model, priors))
    rate, figures = fit(rows, list(weights.values()), total, stay)
    _tell_miss(domains, figures)
    chance = F.pmod(F.xxhash64("doc_id", "th", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("rate", rate).select(
        "doc_id", "th", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate",
        F.floor(F.col("rate") + chance).cast("int").alias("copies"),
        *(F.lit(x).alias(f"{name}_{d}") for name, figure in (("target", "targets"), ("reached", "reached")) for d, x in zip(domains, figures[figure], strict=True)),
        F.lit(figures["met"]).alias("targets_met"), F.lit(figures["bound"]).alias("fit_bound"),
    )


def mix(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, max_labelled: int = MAX_LABELLED, stay: float = 0.0
) -> DataFrame:
    """``docs`` with each row as often as its copies say, 0 times included; all columns of ``docs`` and no others."""
    some = _rates(docs, labelled, weights, total, max_labelled, stay)
    some = some.groupBy("doc_id", "th").agg(F.first("copies").alias("__copies")).where("__copies > 0")
    some = some.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "__copies")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The row travels as one value, so that no name in it can clash with those used here.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(some, F.col("id").eqNullSafe(F.col("__doc")) & (F.col("key") == F.col("__th")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")


#: The registered mixture: domains by the labelled table, and their shares of the tokens.
WEIGHTS = {"good": 0.97, "plain": 0.03, "toxic": 0.0}
#: ``stay`` of the pipeline: no document goes for an excess below the smallest share that is wanted at all. Least squares
#: would repeat the few documents without any toxic posterior and drop most of the rest, clean ones with them.
STAY = min(w for w in WEIGHTS.values() if w)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labelled table (doc_id, quality, toxic)."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))
