"""Evaluation: expected against observed, as conditional sums in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.functions.hashing import ratio
from recordlens.functions.text import collapse

# Categories and classes that the metrics are restricted to.
FACTUAL = ("exact_known_fact", "project_relationship", "publication_doi")
BOUNDARIES = ("satire_boundary", "formalization_boundary")
BANTER = ("banter", "mock_hostility", "affectionate_insult")
#: Fields that are compared only where the case expects them.
OPTIONAL_FIELDS = ("epistemic_state", "classification", "sarcasm", "hostility", "intent_polarity", "severity", "freshness_limited")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def no_list(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def case_correct(expected: str = "expected", response: str = "response", keys: str = "expected_keys") -> Column:
    """Whether a response meets all that its case expects.

    A key that is absent is not compared; one that is there and null must be null in the response too.
    Ids and provenance are compared as sets in any case: absent means empty.
    """
    e, r = (lambda n: F.col(f"{expected}.{n}")), (lambda n: F.col(f"{response}.{n}"))
    ok = same_set(no_list(e("canonical_ids")), r("canonical_ids")) & same_set(no_list(e("provenance_refs")), r("provenance_refs"))
    for name in OPTIONAL_FIELDS:
        ok = ok & (~F.array_contains(F.col(keys), name) | r(name).eqNullSafe(e(name)))
    return ok & (~F.array_contains(F.col(keys), "answer") | collapse(r("answer")).eqNullSafe(collapse(e("answer"))))


def unsupported(expected: str = "expected", response: str = "response") -> Column:
    """Whether a response asserts what its case does not support."""
    e, r = (lambda n: F.col(f"{expected}.{n}")), (lambda n: F.col(f"{response}.{n}"))
    extra = lambda n: F.size(F.array_except(no_list(r(n)), no_list(e(n)))) > 0
    state = ~F.coalesce(r("epistemic_state").isin("unknown", "conflict"), F.lit(False))
    return state | (e("answer").isNull() & r("answer").isNotNull()) | extra("canonical_ids") | extra("provenance_refs")


def clean_unknown(expected: str = "expected", response: str = "response") -> Column:
    return F.coalesce(F.col(f"{response}.epistemic_state") == "unknown", F.lit(False)) & ~unsupported(expected, response)


def rate(hit: Column, among: Column, places: int = 6) -> Column:
    """The share of rows ``among`` that are a ``hit``; null if there are none."""
    return ratio(F.count_if(among & hit), F.count_if(among), places)


def precision_recall(expected: Column, predicted: Column) -> list[Column]:
    return [
        ratio(F.count_if(expected & predicted), F.count_if(predicted)).alias("precision"),
        ratio(F.count_if(expected & predicted), F.count_if(expected)).alias("recall"),
    ]


def brier(confidence: Column, correct: Column, among: Column | None = None) -> Column:
    """Mean squared distance of the confidence from right (1) or wrong (0)."""
    gap = F.pow(confidence.cast("double") - correct.cast("int"), F.lit(2.0))
    return F.bround(F.avg(gap if among is None else F.when(among, gap)), 6)


def general_metrics(knowledge: str, input_tokens: Column) -> list[Column]:
    """The eleven general metrics over rows of case and response, from the suite ``knowledge``."""
    own, category = F.col("suite") == knowledge, F.col("category")
    right, unknown = F.col("correct"), own & (F.col("expected.epistemic_state") == "unknown")
    predicted, wrong = own & clean_unknown(), unsupported()
    refs = own & ((F.size(no_list(F.col("expected.provenance_refs"))) > 0) | (F.size(no_list(F.col("response.provenance_refs"))) > 0))
    true = F.lit(True)
    return [
        rate(right, true).alias("overall_accuracy"),
        rate(right, own & category.isin(*FACTUAL)).alias("factual_accuracy"),
        rate(wrong, unknown).alias("unsupported_assertion_rate"),
        rate(unknown, predicted).alias("unknown_precision"),
        rate(predicted, unknown).alias("unknown_recall"),
        rate(right, own & (category == "alias_resolution")).alias("alias_resolution_accuracy"),
        rate(same_set(no_list(F.col("expected.provenance_refs")), no_list(F.col("response.provenance_refs"))), refs).alias("provenance_fidelity"),
        rate(right, own & (category == "contradiction")).alias("contradiction_handling"),
        rate(right, own & category.isin(*BOUNDARIES)).alias("claim_boundary_preservation"),
        ratio(F.count_if(right) * 1000, F.max(input_tokens)).alias("context_token_efficiency"),
        rate(wrong, unknown).alias("hallucination_rate"),
    ]


def pragmatic_metrics(suite: str) -> list[Column]:
    """The eight metrics of tone, from the suite ``suite``."""
    own, right = F.col("suite") == suite, F.col("correct")
    e, r = (lambda n: F.col(f"expected.{n}")), (lambda n: F.col(f"response.{n}"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    meant, seen = own & yes(e("sarcasm") == "yes"), own & yes(r("sarcasm") == "yes")
    understated = own & yes(e("classification") == "understatement")
    return [
        rate(right, own).alias("overall_accuracy"),
        rate(meant, seen).alias("sarcasm_precision"),
        rate(seen, meant).alias("sarcasm_recall"),
        rate(~r("intent_polarity").eqNullSafe(e("intent_polarity")), own & F.array_contains("tags", "literal-trap")).alias("literal_meaning_error_rate"),
        rate(~yes(r("classification").isin(*BANTER)), own & yes(e("classification").isin(*BANTER))).alias("banter_misclassification_rate"),
        rate(yes(r("hostility") == "actual"), own & ~yes(e("hostility") == "actual")).alias("hostility_false_positive_rate"),
        rate(r("severity").eqNullSafe(e("severity")), understated).alias("understatement_severity_preservation_rate"),
        brier(F.col("response.confidence"), right, own).alias("confidence_brier"),
    ]


def category_accuracy(rows: DataFrame, category: str = "category", correct: str = "correct") -> DataFrame:
    return rows.groupBy(category).agg(rate(F.col(correct), F.lit(True)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def baseline_uplift(rows: DataFrame, identity: list[str], condition: str, baseline: str, metric: str) -> DataFrame:
    """``rows`` with the baseline's metric of the same identity and the difference; null if there is none."""
    base = F.max(F.when(F.col(condition) == baseline, F.col(metric))).over(Window.partitionBy(*identity))
    return rows.withColumn("baseline", base).withColumn("uplift", F.bround(F.col(metric) - F.col("baseline"), 6))


def paired_deltas(rows: DataFrame, by: str, variant: str, first: str, second: str, metrics: dict[str, int]) -> DataFrame:
    """Per group the difference of two variants; metrics of sign -1 are better when lower. Null if one lacks."""
    pick = lambda m, v: F.max(F.when(F.col(variant) == v, F.col(m)))
    return rows.groupBy(by).agg(*(F.bround(s * (pick(m, first) - pick(m, second)), 6).alias(f"{m}_delta") for m, s in metrics.items()))


def effect_class(deltas: Column) -> Column:
    """The sign of an array of differences: improved, degraded, mixed, neutral or unavailable."""
    up, down = F.exists(deltas, lambda x: x > 0), F.exists(deltas, lambda x: x < 0)
    known = F.filter(deltas, lambda x: x.isNotNull())
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    return F.when(F.size(known) == 0, "unavailable").when(up & down, "mixed").when(up, "improved").when(down, "degraded").otherwise("neutral")


def gate(checks: dict[str, Column]) -> list[Column]:
    """Each check with null as failed, and all of them together."""
    sound = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    passed = F.lit(True)
    for c in sound.values():
        passed = passed & c
    return [*(c.alias(n) for n, c in sound.items()), passed.alias("passed")]


def overall_effect(classes: Column) -> Column:
    """The effect of an array of effects; those that are unavailable don't count."""
    known = F.filter(classes, lambda c: c != "unavailable")
    has = lambda c: F.array_contains(known, c)
    both = has("mixed") | (has("improved") & has("degraded"))
    return F.when(F.size(known) == 0, "unavailable").when(both, "mixed").when(has("improved"), "improved").when(has("degraded"), "degraded").otherwise("neutral")


# Floors and ceilings of the consumer gate and of the strict gate.
CONSUMER_GATE = {
    "primary_status_accuracy": (">=", 0.90),
    "register_accuracy": (">=", 0.90),
    "evidence_fidelity": (">=", 0.80),
    "unsupported_assertion_rate": ("<=", 0.0),
    "per_status_accuracy": (">=", 0.80),
    "satire_register_accuracy": (">=", 0.80),
    "evidence_ref_violations": ("<=", 0.0),
}
STRICT_GATE = {
    "adjacency_status_accuracy": (">=", 0.80),
    "adjacency_false_support_rate": ("<=", 0.0),
    "unavailable_status_accuracy": (">=", 0.80),
    "unavailable_spurious_evidence_rate": ("<=", 0.0),
}
UNAVAILABLE = "UNAVAILABLE_UNVERIFIED"


def threshold_checks(limits: dict[str, tuple[str, float]], overrides: dict[str, float] | None = None) -> dict[str, Column]:
    out = {}
    for name, (sense, limit) in limits.items():
        limit = (overrides or {}).get(name, limit)
        out[f"{name}_ok"] = F.col(name) >= limit if sense == ">=" else F.col(name) <= limit
    return out


def compatibility_mismatches(actual: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """(mismatches): names of the fields in which two one-row identities differ; null equals null."""
    a = actual.select(*(F.col(f).alias(f"a_{f}") for f in fields))
    b = expected.select(*(F.col(f).alias(f"b_{f}") for f in fields))
    names = F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields))
    return a.join(F.broadcast(b)).select(F.array_compact(names).alias("mismatches"))


def _audit(name: str) -> tuple[Column, Column]:
    return F.col(f"expected.{name}"), F.col(f"actual.{name}")


def claim_metrics() -> list[Column]:
    """Five metrics of audited claims (expected, actual); evidence may hold more than is expected."""
    (e_status, a_status), (e_register, a_register), (e_refs, a_refs) = map(_audit, ("epistemic_status", "register", "evidence_refs"))
    status, register = a_status.eqNullSafe(e_status), a_register.eqNullSafe(e_register)
    evidence, claims = F.size(F.array_except(no_list(e_refs), no_list(a_refs))) == 0, F.lit(True)
    return [
        rate(status & register & evidence, claims).alias("overall_accuracy"),
        rate(status, claims).alias("primary_status_accuracy"),
        rate(register, claims).alias("register_accuracy"),
        rate(evidence, claims).alias("evidence_fidelity"),
        rate(~a_status.eqNullSafe(F.lit(UNAVAILABLE)), e_status == UNAVAILABLE).alias("unsupported_assertion_rate"),
    ]


def targeted_metrics(trap: Column) -> list[Column]:
    """Seven metrics of the claims that ``trap`` marks, of unavailable ones and of satire; evidence as a multiset."""
    (e_status, a_status), (e_register, a_register), (e_refs, a_refs) = map(_audit, ("epistemic_status", "register", "evidence_refs"))
    status, unavailable, satire = a_status.eqNullSafe(e_status), e_status == UNAVAILABLE, e_register == "satire"
    exact = F.array_sort(no_list(a_refs)) == F.array_sort(no_list(e_refs))
    return [
        rate(status, trap).alias("adjacency_status_accuracy"),
        rate(a_status.eqNullSafe(F.lit("SUPPORTED")), trap).alias("adjacency_false_support_rate"),
        rate(exact, trap).alias("adjacency_evidence_fidelity"),
        rate(a_status.eqNullSafe(F.lit(UNAVAILABLE)), unavailable).alias("unavailable_status_accuracy"),
        rate(F.size(no_list(a_refs)) > 0, unavailable).alias("unavailable_spurious_evidence_rate"),
        rate(a_register.eqNullSafe(F.lit("satire")), satire).alias("satire_register_accuracy"),
        rate(status, satire).alias("satire_status_accuracy"),
    ]
