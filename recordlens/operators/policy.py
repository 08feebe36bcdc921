"""Rule classifier over signals, maturity order and declarative constraints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import ratio
from recordlens.functions.text import safe_path
from recordlens.operators.relations import all_findings, dangling, findings

# The order of maturity, the classifier's statuses and reasons, and its numeric limits.
MATURITY = ["UNKNOWN", "SPECULATIVE", "PROPOSED", "THEORETICAL", "PRELIMINARY", "CONTESTED", "SUPPORTED", "CONSENSUS", "ESTABLISHED"]
VARIANTS = ("rule_only", "sparse_24d")


def maturity_rank(level: Column, levels: list[str] | None = None) -> Column:
    """The place of a level in the order, from 1; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels or MATURITY)), level), F.lit(0))


def maturity_exceeds(requested: Column, entitlement: Column, levels: list[str] | None = None) -> Column:
    """Whether more is asked for than the evidence entitles to; raises for a level that is null or unknown."""
    a, b = maturity_rank(requested, levels), maturity_rank(entitlement, levels)
    return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("a maturity is not of the declared order")).cast("boolean")).otherwise(a > b)


def maturity_problems(rows: DataFrame, key: str, levels: list[str] | None = None) -> DataFrame:
    """(key, field) of the maturities that are null or not in the order."""
    fields = ("requested_maturity", "evidence_entitlement")
    bad = F.array_compact(F.array(*(F.when(maturity_rank(F.col(f), levels).isNull(), F.lit(f)) for f in fields)))
    return rows.select(key, F.explode(bad).alias("field"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def classify(rows: DataFrame, sparse: Column | None = None, levels: list[str] | None = None) -> DataFrame:
    """``rows`` of signals with status and reason_codes.

    Unresolved terms, freshness and conflicts end the decision at once, in that order; so does a binding
    legal claim without a jurisdiction, whatever was found before it. Else every breach gives a reason.
    ``sparse``: whether the numeric rules apply to a row. A maturity that is null or not in the order is refused
    when the plan runs, by whatever reads the status; ``maturity_problems`` tells such rows beforehand.
    """
    sparse = F.lit(True) if sparse is None else sparse
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    early = (
        F.when(_flag("terminology_required") & ~_flag("terminology_resolved"), "AMBIGUOUS_TERMINOLOGY")
        .when(_flag("freshness_required") & ~_flag("freshness_verified"), "FRESHNESS_OR_VERSION_UNRESOLVED")
        .when(_flag("unresolved_primary_conflict"), "PRIMARY_CONFLICT")
    )
    legal = (F.col("primary_mode") == "LEGAL") & (text("claim_scope") == "legal_rule") & _flag("binding_claim")
    medical = (F.col("primary_mode") == "MEDICAL") & (text("claim_scope") == "clinical_guidance")
    early = F.when(early.isNull() & legal & ~_flag("jurisdiction_resolved"), "JURISDICTION_UNRESOLVED").otherwise(early)
    exceeds = maturity_exceeds(F.col("requested_maturity"), F.col("evidence_entitlement"), levels) & ~_flag("scenario_to_actual_promotion")
    secondary = legal & (text("source_authority_class") != "primary_legal_authority")
    preprint = medical & text("publication_state").isin("preprint", "repository")
    crosses = (_number("cross_domain_dependence") >= 0.5) | (F.size(F.coalesce("secondary_modes", F.array().cast("array<string>"))) > 0)
    authority, provenance, evidence = _number("source_authority"), _number("provenance_completeness"), _number("evidentiary_strength")
    rules = {
        "CLAIM_STRENGTH_EXCEEDS_ENTITLEMENT": exceeds,
        "DOI_NOT_VALIDATION": exceeds & _flag("doi_only"),
        "AUTHORITY_SCOPE_MISMATCH": F.coalesce(F.col("source_scope_matches").cast("boolean") == F.lit(False), F.lit(False)),
        "REGISTER_LOSS": _flag("register_loss"),
        "SCENARIO_PROMOTION": _flag("scenario_to_actual_promotion"),
        "PRIMARY_LEGAL_AUTHORITY_REQUIRED": secondary,
        "PREPRINT_NON_NORMATIVE_CLINICAL": preprint,
        "BRIDGE_REQUIRED": crosses & ~_flag("declared_bridge"),
        "HIGH_SAFETY_LOW_EVIDENCE_UNCERTAINTY_REQUIRED": sparse & (_number("safety_criticality") >= 0.8) & (evidence <= 0.3) & (_number("uncertainty") < 0.7),
        "LEGAL_BINDING_AUTHORITY_GEOMETRY": sparse & legal & ~secondary & ((authority < 0.9) | (provenance < 0.9) | (_number("jurisdiction_specific") < 0.5)),
        "MEDICAL_CLINICAL_GUIDANCE_GEOMETRY": sparse & medical & ~preprint & ((authority < 0.8) | (evidence < 0.7) | (provenance < 0.9)),
    }
    reasons = F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))
    fine = (
        F.when((F.col("primary_mode") == "LEGAL") & _flag("binding_claim"), "PRIMARY_AUTHORITY_RESOLVED")
        .when(medical, "CURRENT_GUIDANCE_RESOLVED")
        .when(sparse & (_number("safety_criticality") >= 0.8) & (evidence <= 0.3) & (_number("uncertainty") >= 0.7), "UNCERTAINTY_PRESERVED")
        .when(F.col("requested_maturity") == F.col("evidence_entitlement"), "CLAIM_WITHIN_ENTITLEMENT")
        .otherwise("POLICY_SATISFIED")
    )
    marked = rows.withColumns({"__early": early, "__reasons": reasons, "__crosses": crosses, "__fine": fine})
    status = (
        F.when(F.col("__early").isNotNull(), "MODE_UNRESOLVED")
        .when(F.size("__reasons") > 0, "MODE_VIOLATION")
        .when(F.col("__crosses"), "MODE_CROSSOVER")
        .otherwise("MODE_OK")
    )
    codes = (
        F.when(F.col("__early").isNotNull(), F.array("__early"))
        .when(F.size("__reasons") > 0, F.col("__reasons"))
        .when(F.col("__crosses"), F.array(F.lit("DECLARED_BRIDGE")))
        .otherwise(F.array("__fine"))
    )
    return marked.withColumns({"status": status, "reason_codes": codes}).drop("__early", "__reasons", "__crosses", "__fine")


def self_score(classified: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy of status and of reasons against (expected_status, expected_reasons), per group and overall."""
    right = F.col("status").eqNullSafe(F.col("expected_status"))
    reasons = F.array_sort("reason_codes").eqNullSafe(F.array_sort("expected_reasons"))
    return classified.rollup(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg(right.cast("int")), 6).alias("accuracy"),
        F.bround(F.avg(reasons.cast("int")), 6).alias("reason_accuracy"),
    )


def constraint(when: dict, require: dict) -> Column:
    """True where a declarative constraint is violated: its conditions hold and a requirement does not.

    Keys that end in _min or _max bound the axis before them; others must equal their value. A missing
    axis counts as zero.
    """

    def holds(conditions: dict) -> Column:
        out = F.lit(True)
        for key, value in conditions.items():
            if key.endswith("_min"):
                out = out & (_number(key[:-4]) >= value)
            elif key.endswith("_max"):
                out = out & (_number(key[:-4]) <= value)
            else:
                out = out & F.col(key).eqNullSafe(F.lit(value))
        return out

    return holds(when) & ~holds(require)


def threshold_problems(thresholds: DataFrame, axes: DataFrame) -> DataFrame:
    """(name, problem) for declared thresholds (name, value): no bound suffix, unknown axis, out of 0 to 1."""
    axis = F.regexp_replace("name", "_(min|max)$", "")
    joined = thresholds.join(axes.select(F.col("axis").alias("__axis")), axis == F.col("__axis"), "left")
    problem = F.when(~F.col("name").rlike("_(min|max)$"), "no bound").when(F.col("__axis").isNull(), "unknown axis").when(~F.col("value").between(0, 1), "out of range")
    return joined.select("name", problem.alias("problem")).where("problem is not null")


def maturity_grid(levels: DataFrame) -> DataFrame:
    """All ordered pairs of ``levels`` (level, place) with whether the first one asks for more."""
    names = [r["level"] for r in levels.orderBy("place").collect()]  # an order has few levels
    pairs = levels.select(F.col("level").alias("requested_maturity"), F.explode(F.array(*map(F.lit, names))).alias("evidence_entitlement"))
    return pairs.withColumn("violates", maturity_exceeds(F.col("requested_maturity"), F.col("evidence_entitlement"), names))


def consumer_score(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How a consumer did: counts and rates over (status, reason_codes, expected_status, expected_reasons, secondary_modes).

    A case is correct if status and reasons are. A false OK says MODE_OK where that was not expected. Rates of
    nothing are null.
    """
    none = F.array().cast("array<string>")
    status = F.col("status").eqNullSafe(F.col("expected_status"))
    reasons = F.array_sort(F.coalesce("reason_codes", none)) == F.array_sort(F.coalesce("expected_reasons", none))
    false_ok = (F.col("status") == "MODE_OK") & ~F.col("expected_status").eqNullSafe(F.lit("MODE_OK"))
    crosses = F.size(F.coalesce("secondary_modes", none)) > 0
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(
        n.alias("total"),
        F.count_if(status & reasons).alias("correct"),
        F.count_if(reasons).alias("reason_codes_correct"),
        F.count_if(false_ok).alias("false_mode_ok"),
        F.count_if(crosses).alias("cross_mode_total"),
        F.count_if(crosses & status & reasons).alias("cross_mode_correct"),
        ratio(F.count_if(status & reasons), n).alias("accuracy"),
        ratio(F.count_if(reasons), n).alias("reason_code_accuracy"),
        ratio(F.count_if(false_ok), n).alias("false_mode_ok_rate"),
        ratio(F.count_if(crosses & status & reasons), F.count_if(crosses)).alias("cross_mode_accuracy"),
    )


# What must agree before reports are compared, and the rates that are.
REPORT_IDENTITY = ("mode_bundle_sha256", "mode_policy_sha256", "source_commit", "content_sha256")
REPORT_RATES = ("accuracy", "reason_code_accuracy", "false_mode_ok_rate", "cross_mode_accuracy")
EMPIRICAL = "empirical_consumer"


def report_deltas(left: DataFrame, right: DataFrame, pair: list[str], rates: tuple[str, ...] = REPORT_RATES) -> DataFrame:
    """Per pair (columns in both): right less left of each rate; null if either is."""
    a = left.select(*pair, *(F.col(r).alias(f"__l_{r}") for r in rates))
    return a.join(right.select(*pair, *rates), pair).select(*pair, *(F.bround(F.col(r) - F.col(f"__l_{r}"), 6).alias(f"{r}_delta") for r in rates))


def comparison_problems(left: DataFrame, right: DataFrame) -> list[str]:
    """Why two one-row reports can't be compared: not from a consumer, other identities or models, the same condition."""
    a, b = left.first(), right.first()
    out = [f"{n} report is not of an empirical consumer" for n, r in (("left", a), ("right", b)) if r["execution_kind"] != EMPIRICAL]
    out += [f"reports differ in {f}" for f in (*REPORT_IDENTITY, "model") if a[f] != b[f]]
    return out + (["reports have one condition"] if a["condition"] == b["condition"] else [])


def calibration(reports: DataFrame, conditions: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row of counts and whether they suffice, mean rate by category) of empirical reports.

    ``reports``: execution_kind, the identity, provider, model_id, model_revision, condition and category_accuracy (a map).
    It takes one identity, two model revisions and a report in each of the ``conditions``.
    """
    own = reports.where(F.col("execution_kind") == EMPIRICAL)
    model = F.struct("provider", "model_id", "model_revision")
    per = [F.count_distinct(F.when(F.col("condition") == c, model)).alias(f"models_{c}") for c in conditions]
    counts = own.agg(F.count(F.lit(1)).alias("reports"), F.count_distinct(F.struct(*REPORT_IDENTITY)).alias("identities"), F.count_distinct(model).alias("revisions"), *per)
    enough = (F.col("identities") == 1) & (F.col("revisions") >= 2)
    for c in conditions:
        enough = enough & (F.col(f"models_{c}") > 0)
    means = own.select(F.explode("category_accuracy").alias("category", "rate")).groupBy("category").agg(F.bround(F.avg("rate"), 6).alias("mean_accuracy"))
    return counts.withColumn("sufficient", enough), means


def witness_cases(base: DataFrame, levels: list[str]) -> DataFrame:
    """The cases that a policy is witnessed by, with check, expected_status and expected_reasons, made from the caller's.

    ``base``: signals of cases in which nothing is amiss; ``levels``: the caller's order of maturity. Each case of ``base`` is asked for all
    ordered pairs of levels; at each level, for a bridge to another field that is or is not declared, which changes no
    entitlement, and for high stakes on weak evidence that is or is not called uncertain; and for law and medicine whose place or
    freshness is open, or whose authorities disagree.
    """
    place = F.array(*map(F.lit, levels))
    asked = ("requested_maturity", "evidence_entitlement")
    first = base.drop(*asked).select("*", F.posexplode(place).alias("i", asked[0]))
    pairs = first.select("*", F.posexplode(place).alias("j", asked[1]))
    either = first.withColumn(asked[1], F.col(asked[0])).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("told"))
    over, told = F.col("i") > F.col("j"), F.col("told")
    fine = F.when(F.col("i") == F.col("j"), "CLAIM_WITHIN_ENTITLEMENT").otherwise("POLICY_SATISFIED")

    def case(frame, check, mode, status, reason, secondary=None, **signals):
        given = {"check": check, "primary_mode": mode, "expected_status": status, "expected_reasons": reason, **signals}
        values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items()}
        values["expected_reasons"] = F.array(values["expected_reasons"])
        values["secondary_modes"] = F.array(*([F.lit(secondary)] if secondary else [])).cast("array<string>")
        return frame.withColumns(values).drop("i", "j", "told")

    law = {"claim_scope": "legal_rule", "source_authority_class": "primary_legal_authority", "binding_claim": True}
    medicine = {"claim_scope": "clinical_guidance", "source_authority_class": "current_clinical_guideline"}
    parts = [
        case(pairs, "strength", "SCIENCE", F.when(over, "MODE_VIOLATION").otherwise("MODE_OK"), F.when(over, "CLAIM_STRENGTH_EXCEEDS_ENTITLEMENT").otherwise(fine)),
        case(
            either, "bridge", "SCIENCE", F.when(told, "MODE_CROSSOVER").otherwise("MODE_VIOLATION"), F.when(told, "DECLARED_BRIDGE").otherwise("BRIDGE_REQUIRED"), "FORMAL",
            cross_domain_dependence=0.5, declared_bridge=told,
        ),
        case(
            either, "geometry", "ENGINEERING", F.when(told, "MODE_OK").otherwise("MODE_VIOLATION"), F.when(told, "UNCERTAINTY_PRESERVED").otherwise("HIGH_SAFETY_LOW_EVIDENCE_UNCERTAINTY_REQUIRED"),
            safety_criticality=0.8, evidentiary_strength=0.3, uncertainty=F.when(told, 0.7).otherwise(0.0),
        ),
        case(base, "high_stakes", "LEGAL", "MODE_UNRESOLVED", "JURISDICTION_UNRESOLVED", jurisdiction_resolved=False, **law),
        case(base, "high_stakes", "MEDICAL", "MODE_UNRESOLVED", "FRESHNESS_OR_VERSION_UNRESOLVED", freshness_required=True, freshness_verified=False, **medicine),
        *(case(base, "conflict", m, "MODE_UNRESOLVED", "PRIMARY_CONFLICT", unresolved_primary_conflict=True, **x) for m, x in (("LEGAL", law), ("MEDICAL", medicine))),
    ]
    return reduce(DataFrame.unionByName, parts)


def policy_witness(base: DataFrame, levels: list[str]) -> DataFrame:
    """(check, cases, passed): every witness case through the classifier."""
    done = classify(witness_cases(base, levels), levels=levels)
    right = F.col("status").eqNullSafe(F.col("expected_status")) & F.col("reason_codes").eqNullSafe(F.col("expected_reasons"))
    return done.groupBy("check").agg(F.count(F.lit(1)).alias("cases"), F.bool_and(right).alias("passed"))


@dataclass(frozen=True)
class PolicyTables:
    """The policy registries as relations.

    modes (id), classes (id), jurisdictions (id), resolvers (id, domain, authority_class, jurisdiction),
    jurisdiction_resolvers (jurisdiction, resolver), specialty_resolvers (specialty, resolver), freshness_classes (id),
    profiles (mode, field, class), senses (term, mode), guards (mode), resources (name, path), files (path).
    """

    modes: DataFrame
    classes: DataFrame
    jurisdictions: DataFrame
    resolvers: DataFrame
    jurisdiction_resolvers: DataFrame
    specialty_resolvers: DataFrame
    freshness_classes: DataFrame
    profiles: DataFrame
    senses: DataFrame
    guards: DataFrame
    resources: DataFrame
    files: DataFrame


def policy_findings(p: PolicyTables) -> DataFrame:
    """(code, path, message): references between the policy registries that lead nowhere or to the wrong thing, repeats, and empty registries.

    Of a repeated term or specialty, what it has twice is found: the registries give a row for each of its senses or resolvers.
    """

    def lost(code: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str, path: str) -> DataFrame:
        return findings(dangling(child, key, parent, parent_key), code, F.col(path), F.concat(F.lit("unknown: "), F.col(key).cast("string")))

    met = p.jurisdiction_resolvers.join(p.resolvers.select(F.col("id").alias("resolver"), "domain", F.col("jurisdiction").alias("__own")), "resolver")
    wrong = met.where(~(F.col("domain").eqNullSafe(F.lit("LEGAL")) & F.col("__own").eqNullSafe(F.col("jurisdiction"))))
    twice = lambda code, rows, *keys: findings(rows.groupBy(*keys).count().where("count > 1"), code, F.col(keys[0]), F.lit("repeated"))
    empty = lambda name, rows: findings(rows.agg(F.count("*").alias("n")).where("n = 0"), "policy.empty", F.lit(name), F.lit("a registry without rows"))
    unsafe = p.resources.where(~F.coalesce(safe_path(F.col("path")), F.lit(False)))
    return all_findings([
        lost("policy.resolver_mode", p.resolvers, "domain", p.modes, "id", "id"),
        lost("policy.resolver_class", p.resolvers, "authority_class", p.classes, "id", "id"),
        lost("policy.resolver_jurisdiction", p.resolvers, "jurisdiction", p.jurisdictions, "id", "id"),
        lost("policy.jurisdiction_resolver", p.jurisdiction_resolvers, "resolver", p.resolvers, "id", "jurisdiction"),
        findings(wrong, "policy.jurisdiction_match", F.col("jurisdiction"), F.concat(F.lit("another domain or jurisdiction: "), F.col("resolver"))),
        lost("policy.specialty_resolver", p.specialty_resolvers, "resolver", p.resolvers, "id", "specialty"),
        lost("policy.profile_mode", p.profiles, "mode", p.modes, "id", "mode"),
        lost("policy.profile_class", p.profiles, "class", p.freshness_classes, "id", "mode"),
        lost("policy.sense_mode", p.senses, "mode", p.modes, "id", "term"),
        lost("policy.guard_mode", p.guards, "mode", p.modes, "id", "mode"),
        lost("policy.resource_file", p.resources, "path", p.files, "path", "name"),
        findings(unsafe, "policy.resource_path", F.col("name"), F.lit("path is not safe")),
        twice("policy.resolver_repeated", p.resolvers, "id"),
        twice("policy.jurisdiction_repeated", p.jurisdictions, "id"),
        twice("policy.jurisdiction_resolver_repeated", p.jurisdiction_resolvers, "jurisdiction", "resolver"),
        twice("policy.specialty_repeated", p.specialty_resolvers, "specialty", "resolver"),
        twice("policy.term_repeated", p.senses, "term", "mode"),
        *(empty(name, getattr(p, name)) for name in ("modes", "classes", "freshness_classes", "guards")),
    ])


def embedding_findings(texts: DataFrame, policy: str) -> DataFrame:
    """Findings on transports (path, content) that do not hold the canonical policy text."""
    return findings(texts.where(~F.coalesce(F.contains("content", F.lit(policy)), F.lit(False))), "delivery.embedding", F.col("path"), F.lit("the policy is not embedded"))
