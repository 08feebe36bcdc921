"""Queries that score expected against observed and classify by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.functions.hashing import ratio
from recordlens.operators import metrics, policy
from recordlens.plans.catalogue import Catalogue

QUERIES = Catalogue()

_SCORED = """
s AS (
  SELECT d.doc_id, lang, source, quality, toxic, n_chars > 1500 AS predicted, least(1.0, n_chars / 5000.0)::DOUBLE AS confidence,
    (n_chars > 1500) = (quality = 1) AS correct FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def _scored(t):
    docs = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id")
    predicted = F.col("n_chars") > 1500
    return docs.select(
        "doc_id", "lang", "source", "quality", "toxic", predicted.alias("predicted"),
        F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("confidence"), (predicted == (F.col("quality") == 1)).alias("correct"),
    )


def _rate_sql(hit: str, among: str = "true") -> str:
    return f"CASE WHEN count_if({among}) = 0 THEN NULL ELSE round_even(count_if(({among}) AND ({hit}))::DOUBLE / count_if({among}), 6) END"


@QUERIES.add("category_accuracy", f"WITH {_SCORED} SELECT lang, {_rate_sql('correct')} AS accuracy, count(*) AS n FROM s GROUP BY lang")
def category_accuracy(t):
    return metrics.category_accuracy(_scored(t), "lang")


@QUERIES.add(
    "precision_recall",
    f"WITH {_SCORED} SELECT {_rate_sql('quality = 1', 'predicted')} AS precision, {_rate_sql('predicted', 'quality = 1')} AS recall FROM s",
)
def precision_recall(t):
    return _scored(t).agg(*metrics.precision_recall(F.col("quality") == 1, F.col("predicted")))


@QUERIES.add("brier", f"WITH {_SCORED} SELECT lang, round_even(avg(pow(confidence - correct::INT, 2)), 6) AS brier FROM s GROUP BY lang")
def brier(t):
    return _scored(t).groupBy("lang").agg(metrics.brier(F.col("confidence"), F.col("correct")).alias("brier"))


@QUERIES.add(
    "baseline_uplift",
    """WITH g AS (SELECT user_id % 10 AS bucket, event_type, round_even(sum(value::DECIMAL(18, 2))::DOUBLE / count(*), 4) AS mean_value FROM events GROUP BY 1, 2)
SELECT bucket, event_type, mean_value, max(CASE WHEN event_type = 'view' THEN mean_value END) OVER (PARTITION BY bucket) AS baseline,
round_even(mean_value - max(CASE WHEN event_type = 'view' THEN mean_value END) OVER (PARTITION BY bucket), 6) AS uplift FROM g""",
)
def baseline_uplift(t):
    mean = F.bround(F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 4)
    groups = t("events").groupBy((F.col("user_id") % 10).alias("bucket"), "event_type").agg(mean.alias("mean_value"))
    return metrics.baseline_uplift(groups, ["bucket"], "event_type", "view", "mean_value")


_PAIRED = """
g AS (
  SELECT o_orderpriority, o_orderstatus, round_even(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*), 2) AS mean_price,
    round_even(count_if(o_totalprice > 200000)::DOUBLE / count(*), 6) AS dear_share FROM orders GROUP BY 1, 2
), p AS (
  SELECT o_orderpriority,
    round_even(max(CASE WHEN o_orderstatus = 'O' THEN mean_price END) - max(CASE WHEN o_orderstatus = 'F' THEN mean_price END), 6) AS mean_price_delta,
    round_even(-1 * (max(CASE WHEN o_orderstatus = 'O' THEN dear_share END) - max(CASE WHEN o_orderstatus = 'F' THEN dear_share END)), 6) AS dear_share_delta
  FROM g GROUP BY 1
)"""


def _paired(t):
    n = F.count(F.lit(1))
    groups = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.bround(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / n, 2).alias("mean_price"),
        ratio(F.count_if(F.col("o_totalprice") > 200000), n).alias("dear_share"),
    )
    return metrics.paired_deltas(groups, "o_orderpriority", "o_orderstatus", "O", "F", {"mean_price": 1, "dear_share": -1})


@QUERIES.add("paired_delta", f"WITH {_PAIRED} SELECT * FROM p")
def paired_delta(t):
    return _paired(t)


@QUERIES.add(
    "effect_class",
    f"""WITH {_PAIRED} SELECT o_orderpriority, CASE WHEN mean_price_delta IS NULL AND dear_share_delta IS NULL THEN 'unavailable'
WHEN (coalesce(mean_price_delta > 0, false) OR coalesce(dear_share_delta > 0, false)) AND (coalesce(mean_price_delta < 0, false) OR coalesce(dear_share_delta < 0, false)) THEN 'mixed'
WHEN coalesce(mean_price_delta > 0, false) OR coalesce(dear_share_delta > 0, false) THEN 'improved'
WHEN coalesce(mean_price_delta < 0, false) OR coalesce(dear_share_delta < 0, false) THEN 'degraded' ELSE 'neutral' END AS effect FROM p""",
)
def effect_class(t):
    return _paired(t).select("o_orderpriority", metrics.effect_class(F.array("mean_price_delta", "dear_share_delta")).alias("effect"))


@QUERIES.add(
    "group_sets",
    "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), ())",
)
def group_sets(t):
    docs = t("documents")
    return docs.groupingSets([["lang"], ["lang", "source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _signals(t):
    """Signals of a case for every order, made of its columns."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    level = lambda x: F.element_at(F.array(*map(F.lit, policy.MATURITY)), (x % 9 + 1).cast("int"))
    flag = lambda n: k % n == 0
    tenth = lambda n: (k % n) / 10.0
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "LEGAL").when(F.col("o_orderpriority") == "2-HIGH", "MEDICAL").otherwise("SCIENCE")
    return t("orders").select(
        "o_orderkey",
        mode.alias("primary_mode"),
        F.when(k % 19 == 0, F.array(F.lit("SATIRE"))).otherwise(F.array().cast("array<string>")).alias("secondary_modes"),
        level(k).alias("requested_maturity"), level(c).alias("evidence_entitlement"),
        flag(31).alias("terminology_required"), flag(2).alias("terminology_resolved"), flag(29).alias("freshness_required"), flag(3).alias("freshness_verified"),
        flag(37).alias("unresolved_primary_conflict"), flag(23).alias("scenario_to_actual_promotion"), flag(5).alias("doi_only"), (k % 17 != 0).alias("source_scope_matches"),
        flag(41).alias("register_loss"), flag(2).alias("binding_claim"), (k % 3 != 0).alias("jurisdiction_resolved"), flag(7).alias("declared_bridge"),
        F.when(mode == "LEGAL", "legal_rule").otherwise("clinical_guidance").alias("claim_scope"),
        F.when(k % 4 == 0, "primary_legal_authority").otherwise("secondary").alias("source_authority_class"),
        F.when(k % 5 == 0, "preprint").otherwise("published").alias("publication_state"),
        tenth(11).alias("source_authority"), tenth(10).alias("provenance_completeness"), tenth(9).alias("evidentiary_strength"), tenth(8).alias("jurisdiction_specific"),
        tenth(10).alias("safety_criticality"), tenth(11).alias("uncertainty"), tenth(7).alias("cross_domain_dependence"),
    )


_SIGNALS = f"""
g AS (
  SELECT o_orderkey, o_orderkey AS k, o_orderkey % 9 AS req, o_custkey % 9 AS ent,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'LEGAL' WHEN '2-HIGH' THEN 'MEDICAL' ELSE 'SCIENCE' END AS mode,
    (o_orderkey % 11) / 10.0 AS t11, (o_orderkey % 10) / 10.0 AS t10, (o_orderkey % 9) / 10.0 AS t9, (o_orderkey % 8) / 10.0 AS t8, (o_orderkey % 7) / 10.0 AS t7
  FROM orders
), b AS (
  SELECT *, mode = 'LEGAL' AND k % 2 = 0 AS legal, mode = 'MEDICAL' AS medical, t7 >= 0.5 OR k % 19 = 0 AS crosses, req > ent AND k % 23 <> 0 AS exceeds FROM g
), e AS (
  SELECT *, CASE WHEN k % 31 = 0 AND k % 2 <> 0 THEN 'AMBIGUOUS_TERMINOLOGY' WHEN k % 29 = 0 AND k % 3 <> 0 THEN 'FRESHNESS_OR_VERSION_UNRESOLVED'
      WHEN k % 37 = 0 THEN 'PRIMARY_CONFLICT' WHEN legal AND k % 3 = 0 THEN 'JURISDICTION_UNRESOLVED' END AS early,
    list_sort(list_filter([
      CASE WHEN exceeds THEN 'CLAIM_STRENGTH_EXCEEDS_ENTITLEMENT' END, CASE WHEN exceeds AND k % 5 = 0 THEN 'DOI_NOT_VALIDATION' END,
      CASE WHEN k % 17 = 0 THEN 'AUTHORITY_SCOPE_MISMATCH' END, CASE WHEN k % 41 = 0 THEN 'REGISTER_LOSS' END, CASE WHEN k % 23 = 0 THEN 'SCENARIO_PROMOTION' END,
      CASE WHEN legal AND k % 4 <> 0 THEN 'PRIMARY_LEGAL_AUTHORITY_REQUIRED' END, CASE WHEN medical AND k % 5 = 0 THEN 'PREPRINT_NON_NORMATIVE_CLINICAL' END,
      CASE WHEN crosses AND k % 7 <> 0 THEN 'BRIDGE_REQUIRED' END,
      CASE WHEN sparse AND t10 >= 0.8 AND t9 <= 0.3 AND t11 < 0.7 THEN 'HIGH_SAFETY_LOW_EVIDENCE_UNCERTAINTY_REQUIRED' END,
      CASE WHEN sparse AND legal AND k % 4 = 0 AND (t11 < 0.9 OR t10 < 0.9 OR t8 < 0.5) THEN 'LEGAL_BINDING_AUTHORITY_GEOMETRY' END,
      CASE WHEN sparse AND medical AND k % 5 <> 0 AND (t11 < 0.8 OR t9 < 0.7 OR t10 < 0.9) THEN 'MEDICAL_CLINICAL_GUIDANCE_GEOMETRY' END
    ], lambda x: x IS NOT NULL)) AS reasons FROM b, v
), c AS (
  SELECT o_orderkey, mode, variant, CASE WHEN early IS NOT NULL THEN 'MODE_UNRESOLVED' WHEN len(reasons) > 0 THEN 'MODE_VIOLATION' WHEN crosses THEN 'MODE_CROSSOVER' ELSE 'MODE_OK' END AS status,
    CASE WHEN early IS NOT NULL THEN early WHEN len(reasons) > 0 THEN array_to_string(reasons, ',') WHEN crosses THEN 'DECLARED_BRIDGE'
      WHEN mode = 'LEGAL' AND k % 2 = 0 THEN 'PRIMARY_AUTHORITY_RESOLVED' WHEN medical THEN 'CURRENT_GUIDANCE_RESOLVED'
      WHEN sparse AND t10 >= 0.8 AND t9 <= 0.3 AND t11 >= 0.7 THEN 'UNCERTAINTY_PRESERVED' WHEN req = ent THEN 'CLAIM_WITHIN_ENTITLEMENT' ELSE 'POLICY_SATISFIED' END AS reasons FROM e
)"""


@QUERIES.add("mode_classify", f"WITH v AS (SELECT true AS sparse, 'sparse_24d' AS variant), {_SIGNALS} SELECT o_orderkey, status, reasons FROM c")
def mode_classify(t):
    return policy.classify(_signals(t)).select("o_orderkey", "status", F.array_join("reason_codes", ",").alias("reasons"))


@QUERIES.add(
    "mode_score",
    f"""WITH v AS (SELECT unnest([true, false]) AS sparse, unnest(['sparse_24d', 'rule_only']) AS variant), {_SIGNALS},
w AS (SELECT a.variant, a.mode, a.status = b.status AS ok, a.reasons = b.reasons AS rok FROM c a JOIN c b ON a.o_orderkey = b.o_orderkey AND b.variant = 'sparse_24d')
SELECT variant, mode AS primary_mode, count(*) AS n, round_even(avg(ok::INT), 6) AS accuracy, round_even(avg(rok::INT), 6) AS reason_accuracy FROM w GROUP BY ROLLUP (variant, mode)""",
)
def mode_score(t):
    signals = _signals(t)
    expected = policy.classify(signals).select("o_orderkey", F.col("status").alias("expected_status"), F.col("reason_codes").alias("expected_reasons"))
    both = signals.withColumn("variant", F.explode(F.array(*map(F.lit, policy.VARIANTS))))
    scored = policy.classify(both, F.col("variant") == "sparse_24d").join(expected, "o_orderkey")
    return policy.self_score(scored, ["variant", "primary_mode"])


@QUERIES.add(
    "policy_grid",
    "SELECT a.r_name AS requested_maturity, b.r_name AS evidence_entitlement, a.r_regionkey > b.r_regionkey AS violates FROM region a, region b",
)
def policy_grid(t):
    return policy.maturity_grid(t("region").select(F.col("r_name").alias("level"), F.col("r_regionkey").alias("place")))


@QUERIES.add(
    "geometry_constraints",
    f"WITH v AS (SELECT true AS sparse, '' AS variant), {_SIGNALS} SELECT o_orderkey FROM b WHERE t10 >= 0.8 AND t9 <= 0.3 AND NOT t11 >= 0.7",
)
def geometry_constraints(t):
    bad = policy.constraint({"safety_criticality_min": 0.8, "evidentiary_strength_max": 0.3}, {"uncertainty_min": 0.7})
    return _signals(t).where(bad).select("o_orderkey")
