"""Queries over the policy witness and registries, consumer output, evidence, reports and probe suites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import ratio
from recordlens.operators import bundle, claims, metrics, policy, probes
from recordlens.plans.catalogue import Catalogue
from recordlens.plans.evaluation import _SIGNALS, _signals

QUERIES = Catalogue()


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@QUERIES.add(
    "policy_witness",
    """WITH n AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM region) AS l)
SELECT 'strength' AS "check", s * l * l AS cases, true AS passed FROM n UNION ALL SELECT unnest(['bridge', 'geometry']), 2 * s * l, true FROM n UNION ALL SELECT unnest(['high_stakes', 'conflict']), 2 * s, true FROM n""",
)
def policy_witness(t):
    """Every supplier as a case in which nothing is amiss, and the regions as an order of maturity."""
    k = F.col("s_suppkey")
    numbers = {
        "cross_domain_dependence": k % 50 / 101, "evidentiary_strength": 0.7 + k % 31 / 110, "jurisdiction_specific": 0.5 + k % 7 / 20, "provenance_completeness": 0.9 + k % 11 / 110,
        "safety_criticality": k % 13 / 20, "source_authority": 0.9 + k % 3 / 30, "uncertainty": k % 10 / 10,
    }
    no = ["binding_claim", "declared_bridge", "doi_only", "freshness_required", "register_loss", "scenario_to_actual_promotion", "terminology_required", "unresolved_primary_conflict"]
    yes = ["freshness_verified", "jurisdiction_resolved", "source_scope_matches", "terminology_resolved"]
    texts = {"claim_scope": "fact", "publication_state": "official", "source_authority_class": "scholarly"}
    levels = [r["r_name"] for r in t("region").orderBy("r_regionkey").collect()]
    given = dict.fromkeys(no, False) | dict.fromkeys(yes, True) | texts | dict.fromkeys(["requested_maturity", "evidence_entitlement"], levels[0])
    base = t("supplier").select(*(v.cast("double").alias(c) for c, v in numbers.items()), *(F.lit(v).alias(c) for c, v in given.items()))
    return policy.policy_witness(base, levels)


@QUERIES.add(
    "maturity_problems",
    """SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'requested_maturity' END, CASE WHEN o_custkey % 11 = 0 THEN 'evidence_entitlement' END], lambda x: x IS NOT NULL)) AS field FROM orders""",
)
def maturity_problems(t):
    rows = _signals(t).join(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    odd = rows.withColumn("requested_maturity", F.when(F.col("o_orderkey") % 13 == 0, "ODD").otherwise(F.col("requested_maturity")))
    odd = odd.withColumn("evidence_entitlement", F.when(F.col("o_custkey") % 11 != 0, F.col("evidence_entitlement")))
    return policy.maturity_problems(odd, "o_orderkey")


_RUN = f"""
WITH v AS (SELECT unnest([true, false]) AS sparse, unnest(['sparse_24d', 'rule_only']) AS variant), {_SIGNALS},
w AS (SELECT a.mode, a.o_orderkey, a.status, a.status = b.status AS sok, a.reasons = b.reasons AS rok, a.status = 'MODE_OK' AND b.status <> 'MODE_OK' AS fok, a.o_orderkey % 19 = 0 AS crosses
  FROM c a JOIN c b ON a.o_orderkey = b.o_orderkey AND b.variant = 'sparse_24d' WHERE a.variant = 'rule_only')
"""


def _run(t) -> DataFrame:
    signals = _signals(t)
    expected = policy.classify(signals).select("o_orderkey", F.col("status").alias("expected_status"), F.col("reason_codes").alias("expected_reasons"))
    return policy.classify(signals, F.lit(False)).join(expected, "o_orderkey")


def _share(hit: str, among: str = "true") -> str:
    return f"CASE WHEN count_if({among}) = 0 THEN NULL ELSE round_even(count_if(({among}) AND ({hit}))::DOUBLE / count_if({among}), 6) END"


_SCORE = f"""count(*) AS total, count_if(sok AND rok)::BIGINT AS correct, count_if(rok)::BIGINT AS reason_codes_correct, count_if(fok)::BIGINT AS false_mode_ok,
count_if(crosses)::BIGINT AS cross_mode_total, count_if(crosses AND sok AND rok)::BIGINT AS cross_mode_correct, {_share('sok AND rok')} AS accuracy, {_share('rok')} AS reason_code_accuracy,
{_share('fok')} AS false_mode_ok_rate, {_share('sok AND rok', 'crosses')} AS cross_mode_accuracy"""


@QUERIES.add("consumer_score", f"{_RUN} SELECT mode AS primary_mode, {_SCORE} FROM w GROUP BY mode")
def consumer_score(t):
    return policy.consumer_score(_run(t), ["primary_mode"])


@QUERIES.add(
    "report_delta",
    f"""{_RUN}, l AS (SELECT mode, {_SCORE} FROM w WHERE o_orderkey % 2 = 0 GROUP BY mode), r AS (SELECT mode, {_SCORE} FROM w WHERE o_orderkey % 2 = 1 GROUP BY mode)
SELECT mode AS primary_mode, """
    + ", ".join(f"round_even(r.{x} - l.{x}, 6) AS {x}_delta" for x in policy.REPORT_RATES)
    + " FROM l JOIN r USING (mode)",
)
def report_delta(t):
    run = _run(t)
    even, odd = (policy.consumer_score(run.where(F.col("o_orderkey") % 2 == i), ["primary_mode"]) for i in (0, 1))
    return policy.report_deltas(even, odd, ["primary_mode"])


_CONDITIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@QUERIES.add(
    "calibration",
    """WITH r AS (SELECT o_orderpriority AS condition, o_orderstatus AS model, o_custkey % 7 AS category, round_even(avg((o_totalprice > 150000)::INT), 6) AS rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT category::VARCHAR AS category, round_even(avg(rate), 6) AS mean_accuracy, (SELECT count(DISTINCT model) FROM r) AS revisions, true AS sufficient FROM r GROUP BY category""",
)
def calibration(t):
    rate = F.bround(F.avg((F.col("o_totalprice") > 150000).cast("int")), 6)
    per = t("orders").groupBy("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 7).cast("string").alias("category")).agg(rate.alias("rate"))
    reports = per.groupBy(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("model_id")).agg(F.map_from_entries(F.collect_list(F.struct("category", "rate"))).alias("category_accuracy"))
    kind = F.when(F.col("model_id") == "P", "scoring_oracle").otherwise(policy.EMPIRICAL)
    reports = reports.select("*", kind.alias("execution_kind"), *(F.lit("x").alias(c) for c in (*policy.REPORT_IDENTITY, "provider", "model_revision")))
    counts, means = policy.calibration(reports, _CONDITIONS)
    return means.join(F.broadcast(counts.select("revisions", "sufficient")))


@QUERIES.add(
    "policy_references",
    """SELECT 'policy.resolver_mode' AS code, s_suppkey::VARCHAR AS path FROM supplier WHERE s_nationkey % 8 >= 5
UNION ALL SELECT 'policy.resolver_class', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 9 >= 7
UNION ALL SELECT 'policy.resolver_jurisdiction', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 30 >= 20
UNION ALL SELECT 'policy.jurisdiction_resolver', (c_nationkey)::VARCHAR FROM customer WHERE c_custkey % 150 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'policy.jurisdiction_match', c_nationkey::VARCHAR FROM customer JOIN supplier ON c_custkey % 150 = s_suppkey
  WHERE NOT (s_nationkey % 8 = 0 AND coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END = c_nationkey, false))
UNION ALL SELECT 'policy.specialty_resolver', p_brand FROM part WHERE p_partkey % 130 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'policy.profile_mode', (n_nationkey % 7)::VARCHAR FROM nation WHERE n_nationkey % 7 >= 5 UNION ALL SELECT 'policy.profile_class', (n_nationkey % 7)::VARCHAR FROM nation WHERE n_nationkey % 4 = 3
UNION ALL SELECT 'policy.sense_mode', n_name FROM nation WHERE n_regionkey >= 5 UNION ALL SELECT 'policy.guard_mode', (r_regionkey + 3)::VARCHAR FROM region WHERE r_regionkey + 3 >= 5
UNION ALL SELECT 'policy.resource_file', n_name FROM nation WHERE n_nationkey % 6 = 0 OR n_nationkey % 10 = 0 UNION ALL SELECT 'policy.resource_path', n_name FROM nation WHERE n_nationkey % 6 = 0
UNION ALL SELECT 'policy.specialty_repeated', p_brand FROM part GROUP BY p_brand, p_partkey % 130 HAVING count(*) > 1
UNION ALL SELECT 'policy.jurisdiction_resolver_repeated', c_nationkey::VARCHAR FROM customer GROUP BY c_nationkey, c_custkey % 150 HAVING count(*) > 1""",
)
def policy_references(t):
    spark = t("region").sparkSession
    nation, supplier = t("nation"), t("supplier")
    ids = lambda n: spark.range(n).select(F.col("id"))
    path = F.when(F.col("n_nationkey") % 6 == 0, _text("../", F.col("n_name"))).otherwise(_text("f/", F.col("n_name")))
    tables = policy.PolicyTables(
        modes=ids(5).select(F.when(F.col("id") == 0, "LEGAL").otherwise(F.col("id").cast("string")).alias("id")),
        classes=ids(7),
        jurisdictions=ids(20),
        resolvers=supplier.select(
            F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 8 == 0, "LEGAL").otherwise((F.col("s_nationkey") % 8).cast("string")).alias("domain"),
            (F.col("s_suppkey") % 9).alias("authority_class"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("jurisdiction"),
        ),
        jurisdiction_resolvers=t("customer").select(F.col("c_nationkey").alias("jurisdiction"), (F.col("c_custkey") % 150).alias("resolver")),
        specialty_resolvers=t("part").select(F.col("p_brand").alias("specialty"), (F.col("p_partkey") % 130).alias("resolver")),
        freshness_classes=ids(3),
        profiles=nation.select((F.col("n_nationkey") % 7).alias("k"), (F.col("n_nationkey") % 4).alias("class")).select(F.when(F.col("k") == 0, "LEGAL").otherwise(F.col("k").cast("string")).alias("mode"), F.lit("f").alias("field"), "class"),
        senses=nation.select(F.col("n_name").alias("term"), F.when(F.col("n_regionkey") == 0, "LEGAL").otherwise(F.col("n_regionkey").cast("string")).alias("mode")),
        guards=t("region").select((F.col("r_regionkey") + 3).cast("string").alias("mode")),
        resources=nation.select(F.col("n_name").alias("name"), path.alias("path")),
        files=nation.where("n_nationkey % 10 <> 0").select(_text("f/", F.col("n_name")).alias("path")),
    )
    return policy.policy_findings(tables).select("code", F.when((F.col("path") == "LEGAL"), "0").otherwise(F.col("path")).alias("path"))


def _output(t) -> DataFrame:
    k = F.col("event_id")
    refs = F.when(k % 17 == 0, F.array(F.lit(""))).otherwise(F.array(_text("src:", k % 40), _text("file:d/", k % 30), _text("src:", k % 40)))
    statuses, registers = (F.array(*map(F.lit, x)) for x in ([*claims.STATUSES, "MAYBE"], [*claims.REGISTERS, "odd"]))
    rows = t("events").select(
        _text("c", F.when(k % 41 == 0, k + 1).otherwise(k)).alias("claim_id"), F.element_at(statuses, F.when(k % 19 == 0, 4).otherwise((k % 3 + 1).cast("int"))).alias("epistemic_status"),
        F.element_at(registers, F.when(k % 23 == 0, 4).otherwise((k % 3 + 1).cast("int"))).alias("register"), refs.alias("evidence_refs"), F.when(k % 29 == 0, "  ").otherwise(_text(" because ", k, " ")).alias("rationale"),
    )
    return rows


_OUT = """
o AS (
  SELECT event_id AS k, 'c' || CASE WHEN event_id % 41 = 0 THEN event_id + 1 ELSE event_id END AS claim_id, ['SUPPORTED', 'CONTRADICTED', 'UNAVAILABLE_UNVERIFIED'][event_id % 3 + 1] AS st,
    ['literal', 'satire', 'fictional_control'][event_id % 3 + 1] AS reg, ['src:' || (event_id % 40), 'file:d/' || (event_id % 30)] AS refs FROM events
), f AS (SELECT 'c' || event_id AS id, event_type || ' ' || event_id AS text, event_id AS ordinal FROM events WHERE event_id % 50 <> 7)"""


def _frozen(t) -> DataFrame:
    k = F.col("event_id")
    return t("events").where("event_id % 50 <> 7").select(_text("c", k).alias("id"), _text(F.col("event_type"), " ", k).alias("text"), k.alias("ordinal"))


@QUERIES.add(
    "consumer_output",
    f"""WITH {_OUT}
SELECT 'output.unknown' AS code, claim_id AS path FROM o WHERE claim_id NOT IN (SELECT id FROM f) UNION ALL SELECT 'output.duplicate', claim_id FROM o GROUP BY claim_id HAVING count(*) > 1
UNION ALL SELECT 'output.missing', id FROM f WHERE id NOT IN (SELECT claim_id FROM o) UNION ALL SELECT 'output.status', claim_id FROM o WHERE k % 19 = 0
UNION ALL SELECT 'output.register', claim_id FROM o WHERE k % 23 = 0 UNION ALL SELECT 'output.evidence', claim_id FROM o WHERE k % 17 = 0 UNION ALL SELECT 'output.rationale', claim_id FROM o WHERE k % 29 = 0""",
)
def consumer_output(t):
    return claims.output_findings(_output(t), _frozen(t)).select("code", "path")


@QUERIES.add(
    "normal_output",
    f"""WITH {_OUT}
SELECT ordinal, claim_id, sha256(text) AS claim_sha256, st AS epistemic_status, reg AS register, array_to_string(list_sort(refs), ' ') AS evidence, 'because ' || k AS rationale
FROM o JOIN f ON claim_id = id WHERE k % 41 <> 0 AND k % 19 <> 0 AND k % 23 <> 0 AND k % 17 <> 0 AND k % 29 <> 0""",
)
def normal_output(t):
    sound = _output(t).where("epistemic_status <> 'MAYBE' and register <> 'odd' and evidence_refs[0] <> '' and trim(rationale) <> ''")
    sound = sound.where(F.split("rationale", " ")[2] == F.substr("claim_id", F.lit(2)))
    out = claims.normal_output(sound, _frozen(t))
    return out.select("ordinal", "claim_id", "claim_sha256", "epistemic_status", "register", F.array_join("evidence_refs", " ").alias("evidence"), "rationale")


@QUERIES.add(
    "frozen_claims",
    f"WITH {_OUT} SELECT 'audit.claim_hash' AS code, id AS path FROM f WHERE ordinal % 6 = 0",
)
def frozen_claims(t):
    k = F.col("event_id")
    said = F.sha2(F.when(k % 6 == 0, "other").otherwise(_text(F.col("event_type"), " ", k)), 256)
    return claims.frozen_claim_findings(t("events").select(_text("c", k).alias("claim_id"), said.alias("claim_sha256")), _frozen(t)).select("code", "path")


@QUERIES.add(
    "visible_evidence",
    """SELECT event_id, unnest(list_sort(list_distinct(['src:e' || (event_id % 9), 'src:' || event_type] || CASE WHEN event_id % 4 = 0 THEN [] ELSE ['file:x/' || event_type] END || CASE WHEN event_id % 5 = 0 THEN ['note ' || event_id] ELSE [] END))) AS ref FROM events""",
)
def visible_evidence(t):
    k, kind = F.col("event_id"), F.col("event_type")
    lines = F.concat_ws(
        "\n", _text("see src:e", k % 9, ", and asrc:none (src:", kind, ")"), F.when(k % 4 == 0, "ITEM\tclaim").otherwise(_text("ITEM\tclaim\tx/", kind, "\t{}")),
        F.when(k % 5 == 0, _text("EVIDENCE_REF=  note ", k, " ")).otherwise("EVIDENCE_REF= "), _text(" ITEM\tclaim\tnone"),
    )
    return claims.visible_evidence(t("events").select("event_id", lines.alias("context")), "event_id", "context")


def _ends(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = t("region").sparkSession
    ids = lambda n, prefix, name: spark.range(n).select(_text(prefix, F.col("id")).alias(name))
    return ids(25, "src:", "ref").unionByName(ids(30, "file:d/", "ref")).unionByName(ids(1, "other:", "ref")), ids(20, "src:", "id"), ids(12, "d/", "path").unionByName(ids(5, "../", "path"))


_REFS = "r AS (SELECT o.*, unnest(CASE WHEN k % 17 = 0 THEN [''] ELSE ['src:' || (k % 40), 'file:d/' || (k % 30), 'src:' || (k % 40)] END) AS ref FROM o), x AS (SELECT *, (starts_with(ref, 'src:') AND k % 40 < 20) OR (starts_with(ref, 'file:') AND k % 30 < 12) AS ok FROM r)"


@QUERIES.add("constrained_evidence", f"WITH {_OUT}, {_REFS} SELECT k AS claim, coalesce(string_agg(DISTINCT ref, ' ' ORDER BY ref) FILTER (ok), '') AS evidence FROM x GROUP BY k")
def constrained_evidence(t):
    keyed = t("events").select(F.col("event_id").cast("string").alias("claim_id"), _event_refs().alias("evidence_refs"))
    rows, _ = claims.constrained_evidence(keyed, *_ends(t))
    return rows.select(F.col("claim_id").cast("long").alias("claim"), F.array_join("evidence_refs", " ").alias("evidence"))


def _event_refs():
    k = F.col("event_id")
    return F.when(k % 17 == 0, F.array(F.lit(""))).otherwise(F.array(_text("src:", k % 40), _text("file:d/", k % 30), _text("src:", k % 40)))


@QUERIES.add("evidence_violations", f"WITH {_OUT}, {_REFS} SELECT k::VARCHAR AS claim_id, ref AS evidence_ref FROM x WHERE NOT ok")
def evidence_violations(t):
    rows = t("events").select(F.col("event_id").cast("string").alias("claim_id"), _event_refs().alias("evidence_refs"))
    return claims.constrained_evidence(rows, *_ends(t))[1]


@QUERIES.add(
    "prompts",
    """WITH c AS (SELECT string_agg('- r' || r_regionkey || ': ' || r_name, chr(10) ORDER BY r_regionkey) AS list FROM region)
SELECT n_nationkey AS run_id, 'Classify.' || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'Evidence is local.' || chr(10) ELSE '' END || chr(10) || 'BEGIN CONTEXT' || chr(10) || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END || chr(10) || 'END CONTEXT' || chr(10) || chr(10)
  || 'BEGIN REPORT' || chr(10) || 'about ' || n_name || chr(10) || 'END REPORT' || chr(10) || chr(10) || 'BEGIN CLAIMS' || chr(10) || list || chr(10) || 'END CLAIMS' || chr(10) AS prompt FROM nation, c""",
)
def prompts(t):
    k = F.col("n_nationkey")
    runs = t("nation").select(k.alias("run_id"), F.when(k % 2 == 0, "guarded").otherwise("ablated").alias("variant"), F.when(k % 5 != 0, F.col("n_name")).alias("context"), _text("about ", F.col("n_name")).alias("report"))
    frozen = t("region").select(_text("r", F.col("r_regionkey")).alias("id"), F.col("r_name").alias("text"), F.col("r_regionkey").alias("ordinal"))
    return claims.render_prompts(runs, frozen, ["Classify."], ["Evidence is local."])


@QUERIES.add(
    "evaluation_artifacts",
    """WITH p AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'eval:x' WHEN 1 THEN 'file:Reports/' || page_id || '.md' WHEN 2 THEN 'file:dist/run/' || page_id WHEN 3 THEN 'file:a/Mixed-Run-' || page_id || '.json'
  WHEN 4 THEN 'file:a/mixed-run-' || page_id || '.txt' WHEN 5 THEN 'file:../reports/x' WHEN 6 THEN 'src:reports' WHEN 7 THEN 'file:own.md' ELSE 'file:dist/runs' END AS ref FROM pages)
SELECT page_id, ref, page_id % 9 IN (0, 1, 2, 3, 7) AS artifact FROM p""",
)
def evaluation_artifacts(t):
    k = F.col("page_id")
    kinds = ["eval:x", _text("file:Reports/", k, ".md"), _text("file:dist/run/", k), _text("file:a/Mixed-Run-", k, ".json"), _text("file:a/mixed-run-", k, ".txt"), "file:../reports/x", "src:reports", "file:own.md", "file:dist/runs"]
    ref = F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in kinds)), (k % 9 + 1).cast("int"))
    return t("pages").select("page_id", ref.alias("ref")).select("page_id", "ref", claims.evaluation_artifact(F.col("ref"), ["own.md"], "dist/run", "mixed-run").alias("artifact"))


@QUERIES.add(
    "projection_runs",
    """WITH r AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS path, CASE o_orderkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'latent-prefix' ELSE 'naked' END AS condition, o_orderstatus <> 'P' AS own FROM orders),
n AS (SELECT *, k % 10 <> 0 AS there, k % 10 <> 0 AND k % 14 <> 0 AS bound FROM r WHERE own AND condition <> 'naked')
SELECT 'audit.projection_execution' AS code, path FROM n WHERE NOT there UNION ALL SELECT 'audit.projection_compatibility', path FROM n WHERE there AND NOT bound
UNION ALL SELECT 'audit.projection_compatibility_fingerprint', path FROM n WHERE bound AND k % 11 = 0 UNION ALL SELECT 'audit.projection_model_id', path FROM n WHERE bound AND k % 13 = 0
UNION ALL SELECT 'audit.projection_model_revision', path FROM n WHERE bound AND k % 17 = 0 UNION ALL SELECT 'audit.projection_kind', path FROM n WHERE bound AND (condition = 'hybrid') <> (k % 2 = 0)
UNION ALL SELECT 'audit.projection_runtime', path FROM n WHERE bound AND k % 19 = 0 UNION ALL SELECT 'audit.projection_artifact_hash', path FROM n WHERE bound AND k % 23 = 0
UNION ALL SELECT 'audit.projection_artifact_hash', path FROM n WHERE bound AND k % 29 = 0""",
)
def projection_runs(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 2 == 0, "hybrid").otherwise("soft_prompt")
    compatibility = F.struct(F.lit("m").alias("model_id"), F.when(k % 17 == 0, "other").otherwise("r1").alias("model_revision"), kind.alias("projection_kind"), F.lit(None).cast("string").alias("dtype"))
    text = F.concat(F.lit('{"dtype":null,"model_id":"m","model_revision":"'), F.when(k % 17 == 0, "other").otherwise("r1"), F.lit('","projection_kind":"'), kind, F.lit('"}\n'))
    fingerprint = F.sha2(text, 256)
    projection = F.struct(
        F.when(k % 14 != 0, compatibility).alias("compatibility"), F.when(k % 11 == 0, "x").otherwise(fingerprint).alias("compatibility_fingerprint_sha256"), F.lit("a").alias("projection_artifact_sha256"),
        F.struct(F.when(k % 19 == 0, "b").otherwise("a").alias("executed_projection_sha256"), F.lit("e").alias("evidence_sha256")).alias("runtime"),
    )
    runs = t("orders").select(
        k.cast("string").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "scoring_oracle").otherwise("empirical_consumer").alias("execution_kind"),
        F.when(k % 3 == 0, "hybrid").when(k % 3 == 1, "latent-prefix").otherwise("naked").alias("condition"), F.struct(F.when(k % 13 == 0, "n").otherwise("m").alias("model_id"), F.lit("r1").alias("immutable_model_revision")).alias("evaluator"),
        F.when(k % 10 != 0, projection).alias("projection"),
        F.struct(F.when(k % 23 == 0, "z").otherwise("a").alias("projection_artifact"), F.when(k % 29 == 0, F.lit(None)).otherwise(fingerprint).alias("projection_compatibility"), F.lit("e").alias("projection_runtime_evidence")).alias("artifact_hashes"),
    )
    return claims.projection_findings(runs, ["model_id", "model_revision", "projection_kind", "dtype"]).select("code", "path")


@QUERIES.add(
    "comparison_reports",
    """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 31 = 0 THEN '' ELSE 'run' || c_custkey END AS path FROM customer)
SELECT 'report.artifact_class' AS code, path FROM r WHERE k % 7 = 0 UNION ALL SELECT 'report.execution_kind', path FROM r WHERE k % 11 = 0 UNION ALL SELECT 'report.run_id', path FROM r WHERE k % 31 = 0
UNION ALL SELECT 'report.condition', path FROM r WHERE k % 4 = 3 UNION ALL SELECT 'report.bundle', path FROM r WHERE k % 13 = 0 UNION ALL SELECT 'report.evaluator.model_id', path FROM r WHERE k % 17 = 0
UNION ALL SELECT 'report.snapshot.version', path FROM r WHERE k % 19 = 0 UNION ALL SELECT 'report.identity', path FROM r WHERE k % 23 = 0 UNION ALL SELECT 'report.metrics', path FROM r WHERE k % 29 = 0 OR k % 37 = 0
UNION ALL SELECT 'report.claim_scores', path FROM r WHERE k % 41 = 0""",
)
def comparison_reports(t):
    k = F.col("c_custkey")
    digest = F.sha2(k.cast("string"), 256)
    snapshot = {f: F.lit("x") for f in claims.SNAPSHOT} | {"version": F.when(k % 19 == 0, "").otherwise("1"), "source_commit": F.when(k % 23 == 0, "short").otherwise(F.substr(digest, F.lit(1), F.lit(40))), "content_sha256": digest}
    rates = {m: F.lit(0.5) for m in claims.REPORT_METRICS} | {"register_accuracy": F.when(k % 29 == 0, 1.5).otherwise(1.0), "evidence_fidelity": F.lit(None).cast("double")}
    pack = lambda d: F.struct(*(c.alias(n) for n, c in d.items()))
    reports = t("customer").select(
        F.when(k % 31 == 0, "").otherwise(_text("run", k)).alias("run_id"), F.when(k % 7 == 0, "raw").otherwise("derived_evaluation").alias("artifact_class"),
        F.when(k % 11 == 0, "scoring_oracle").otherwise("empirical_consumer").alias("execution_kind"), _text("c", k % 4).alias("condition"), F.when(k % 13 == 0, F.lit(None)).otherwise(digest).alias("evaluation_bundle_sha256"),
        pack({f: F.lit("x") for f in claims.EVALUATOR} | {"model_id": F.when(k % 17 == 0, F.lit(None)).otherwise("m")}).alias("evaluator"), pack(snapshot).alias("snapshot"), F.when(k % 37 != 0, pack(rates)).alias("metrics"),
        F.when(k % 41 == 0, 0).otherwise(3).alias("claim_scores"),
    )
    return claims.report_findings(reports, ["c0", "c1", "c2"]).select("code", "path")


def _cases(t) -> DataFrame:
    k = F.col("p_partkey")
    null = F.lit(None).cast("string")
    expected = F.struct(
        F.lit("a").alias("answer"), F.when(k % 12 == 0, F.array(F.lit(""))).alias("canonical_ids"), F.array(F.lit("src:1")).alias("provenance_refs"), F.when(k % 9 == 0, "odd").otherwise("known").alias("epistemic_state"),
        null.alias("classification"), F.when(k % 10 == 0, "perhaps").otherwise("no").alias("sarcasm"),
    )
    return t("part").select(
        F.when(k % 53 == 0, F.lit(None)).otherwise(_text("p", F.when(k % 44 == 0, F.lit(44)).otherwise(k))).alias("id"), F.when(k % 14 == 0, "other").otherwise("tone").alias("suite"), F.col("p_brand").alias("category"),
        F.when(k % 15 == 0, "  ").otherwise(F.col("p_name")).alias("prompt"), F.when(k % 16 == 0, F.lit(None)).otherwise(F.array(F.lit("t"))).alias("tags"), F.when(k % 18 != 0, expected).alias("expected"),
    )


@QUERIES.add(
    "probe_cases",
    """WITH c AS (SELECT k, CASE WHEN k % 53 = 0 THEN '' ELSE 'p' || CASE WHEN k % 44 = 0 THEN 44 ELSE k END END AS path, k % 18 <> 0 AS e FROM (SELECT p_partkey AS k FROM part))
SELECT 'probe.suite' AS code, path FROM c WHERE k % 14 = 0 UNION ALL SELECT 'probe.id', path FROM c WHERE path = '' UNION ALL SELECT 'probe.duplicate', path FROM c WHERE path <> '' GROUP BY path HAVING count(*) > 1
UNION ALL SELECT 'probe.prompt', path FROM c WHERE k % 15 = 0 UNION ALL SELECT 'probe.tags', path FROM c WHERE k % 16 = 0 UNION ALL SELECT 'probe.expected', path FROM c WHERE NOT e
UNION ALL SELECT 'probe.canonical_ids', path FROM c WHERE e AND k % 12 = 0 UNION ALL SELECT 'probe.epistemic_state', path FROM c WHERE e AND k % 9 = 0 UNION ALL SELECT 'probe.sarcasm', path FROM c WHERE e AND k % 10 = 0""",
)
def probe_cases(t):
    return probes.case_findings(_cases(t), "tone", {"epistemic_state": ["known", "unknown"], "sarcasm": ["yes", "no"]}).select("code", "path")


@QUERIES.add("built_cases", "SELECT 'a:' || p_partkey AS id, 'a' AS suite FROM part UNION ALL SELECT 'b:' || s_suppkey, 'b' FROM supplier")
def built_cases(t):
    suite = lambda table, key, name: t(table).select(_text(f"{name}:", F.col(key)).alias("id"), F.lit(name).alias("suite"))
    return probes.built_cases([suite("part", "p_partkey", "a"), suite("supplier", "s_suppkey", "b")])


@QUERIES.add("category_counts", "SELECT p_brand AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(t):
    return probes.category_counts(t("part").select(F.col("p_brand").alias("category")))


@QUERIES.add(
    "condition_order",
    "SELECT o_orderkey, o_orderpriority AS condition, list_position(['5-LOW', '1-URGENT', '4-NOT SPECIFIED', '2-HIGH', '3-MEDIUM'], o_orderpriority) - 1 AS place FROM orders",
)
def condition_order(t):
    order = ["5-LOW", "1-URGENT", "4-NOT SPECIFIED", "2-HIGH", "3-MEDIUM"]
    rows = probes.by_condition(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("condition")), order, "o_orderkey")
    return rows.select("o_orderkey", "condition", probes.condition_place(F.col("condition"), order).alias("place"))


_PASSED = {n: f"coalesce({n} {s} {x}, false)" for n, (s, x) in metrics.CONSUMER_GATE.items()}


@QUERIES.add(
    "gate",
    f"""WITH b AS (SELECT l_suppkey % 50 AS run, round_even(avg((l_discount < 0.09)::INT), 6) AS primary_status_accuracy, round_even(avg((l_tax < 0.08)::INT), 6) AS register_accuracy,
  CASE WHEN count_if(l_returnflag = 'R') > 10 THEN round_even(avg((l_quantity > 8)::INT), 6) END AS evidence_fidelity, round_even(avg((l_quantity > 50)::INT), 6) AS unsupported_assertion_rate,
  round_even(avg((l_quantity > 9)::INT), 6) AS per_status_accuracy, 0.9 AS satire_register_accuracy, 0 AS evidence_ref_violations FROM lineitem GROUP BY 1)
SELECT run, {', '.join(f'{c} AS {n}_ok' for n, c in _PASSED.items())}, {' AND '.join(_PASSED.values())} AS passed FROM b""",
)
def gate(t):
    share = lambda c: F.bround(F.avg(c.cast("int")), 6)
    runs = t("lineitem").groupBy((F.col("l_suppkey") % 50).alias("run")).agg(
        share(F.col("l_discount") < 0.09).alias("primary_status_accuracy"), share(F.col("l_tax") < 0.08).alias("register_accuracy"),
        F.when(F.count_if(F.col("l_returnflag") == "R") > 10, share(F.col("l_quantity") > 8)).alias("evidence_fidelity"), share(F.col("l_quantity") > 50).alias("unsupported_assertion_rate"),
        share(F.col("l_quantity") > 9).alias("per_status_accuracy"), F.lit(0.9).alias("satire_register_accuracy"), F.lit(0).alias("evidence_ref_violations"),
    )
    return runs.select("run", *metrics.gate(metrics.threshold_checks(metrics.CONSUMER_GATE)))


_STRICT = {"adjacency_status_accuracy": ">= 0.7", "adjacency_false_support_rate": "<= 0.0", "unavailable_status_accuracy": ">= 0.80", "unavailable_spurious_evidence_rate": "<= 0.0"}


@QUERIES.add(
    "strict_gate",
    f"""WITH b AS (SELECT n_nationkey, 0.5 + n_nationkey / 50.0 AS adjacency_status_accuracy, CASE WHEN n_nationkey % 3 <> 0 THEN 0.0 END AS adjacency_false_support_rate, 0.8 AS unavailable_status_accuracy,
  n_nationkey % 5 / 10.0 AS unavailable_spurious_evidence_rate FROM nation)
SELECT n_nationkey, {', '.join(f'coalesce({n} {c}, false) AS {n}_ok' for n, c in _STRICT.items())}, {' AND '.join(f'coalesce({n} {c}, false)' for n, c in _STRICT.items())} AS passed FROM b""",
)
def strict_gate(t):
    k = F.col("n_nationkey")
    rows = t("nation").select(
        k, (0.5 + k / 50.0).alias("adjacency_status_accuracy"), F.when(k % 3 != 0, 0.0).alias("adjacency_false_support_rate"), F.lit(0.8).alias("unavailable_status_accuracy"),
        (k % 5 / 10.0).alias("unavailable_spurious_evidence_rate"),
    )
    return rows.select("n_nationkey", *metrics.gate(metrics.threshold_checks(metrics.STRICT_GATE, {"adjacency_status_accuracy": 0.7})))


@QUERIES.add("threshold_map", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'no bound' WHEN p_partkey % 5 >= 3 THEN 'unknown axis' WHEN p_partkey % 7 = 0 THEN 'out of range' END AS problem FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 >= 3 OR p_partkey % 7 = 0""")
def threshold_map(t):
    k = F.col("p_partkey")
    name = _text("axis", k % 5, "@", k, F.when(k % 4 == 0, "_max_").when(k % 4 == 1, "_min").otherwise("_max"))
    rows = t("part").select(name.alias("name"), F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("value"))
    axes = t("part").where("p_partkey % 5 < 3").select(_text("axis", k % 5, "@", k).alias("axis"))
    found = policy.threshold_problems(rows, axes)
    return found.select(F.regexp_extract("name", "@([0-9]+)", 1).cast("long").alias("p_partkey"), "problem")


@QUERIES.add(
    "identity_agreement",
    "SELECT count(DISTINCT (lang, source)) AS identities, count(DISTINCT (lang, source)) = 1 AS agree FROM documents",
)
def identity_agreement(t):
    return bundle.identity_disagreement(t("documents"), ["lang", "source"])


_E = """
e AS (
  SELECT d.doc_id, d.lang, quality, toxic, n_chars, CASE WHEN toxic = 1 THEN 'tone' ELSE 'knowledge' END AS suite, ['exact_known_fact', 'alias_resolution', 'contradiction', 'satire_boundary'][n_chars % 4 + 1] AS category,
    CASE WHEN quality = 0 THEN 'unknown' ELSE 'known' END AS es, CASE WHEN n_chars % 5 = 0 THEN 'unknown' ELSE 'known' END AS rs, CASE WHEN n_chars % 3 = 0 THEN [lang] ELSE [] END AS er, CASE WHEN n_chars % 2 = 0 THEN [lang] ELSE [] END AS rr
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
), m AS (
  SELECT *, es = rs AND er = rr AS correct, rs <> 'unknown' OR len(list_filter(rr, lambda x: NOT list_contains(er, x))) > 0 AS wrong FROM e
)"""
_OWN = "suite = 'knowledge'"
_UNK = f"{_OWN} AND es = 'unknown'"
_PRED = f"{_OWN} AND rs = 'unknown' AND NOT wrong"


@QUERIES.add(
    "metric_card",
    f"""WITH {_E} SELECT {_share('correct')} AS overall_accuracy, {_share('correct', f"{_OWN} AND category = 'exact_known_fact'")} AS factual_accuracy, {_share('wrong', _UNK)} AS unsupported_assertion_rate,
{_share(_UNK, _PRED)} AS unknown_precision, {_share(_PRED, _UNK)} AS unknown_recall, {_share('correct', f"{_OWN} AND category = 'alias_resolution'")} AS alias_resolution_accuracy,
{_share('er = rr', f'{_OWN} AND (len(er) > 0 OR len(rr) > 0)')} AS provenance_fidelity, {_share('correct', f"{_OWN} AND category = 'contradiction'")} AS contradiction_handling,
{_share('correct', f"{_OWN} AND category = 'satire_boundary'")} AS claim_boundary_preservation, round_even(count_if(correct) * 1000.0::DOUBLE / 5000, 6) AS context_token_efficiency, {_share('wrong', _UNK)} AS hallucination_rate FROM m""",
)
def metric_card(t):
    return _answers(t).agg(*metrics.general_metrics("knowledge", F.lit(5000)))


def _answers(t) -> DataFrame:
    rows = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id")
    none, k = F.array().cast("array<string>"), F.col("n_chars")
    null = F.lit(None).cast("string")
    words = {"classification": ("banter", "plain"), "sarcasm": ("yes", "no"), "hostility": ("actual", "none"), "intent_polarity": ("plus", "minus"), "severity": ("high", "low")}

    def side(state, refs, shift):
        tone = [F.when((k + shift) % (i + 2) == 0, a).otherwise(b).alias(n) for i, (n, (a, b)) in enumerate(words.items())]
        return F.struct(null.alias("answer"), none.alias("canonical_ids"), F.when(refs, F.array("lang")).otherwise(none).alias("provenance_refs"), F.when(state, "unknown").otherwise("known").alias("epistemic_state"), *tone, F.lit(False).alias("freshness_limited"), (F.lit(0.5) + shift * 0.1).alias("confidence"))

    category = F.element_at(F.array(*map(F.lit, ["exact_known_fact", "alias_resolution", "contradiction", "satire_boundary"])), (k % 4 + 1).cast("int"))
    answers = rows.select(
        F.when(F.col("toxic") == 1, "tone").otherwise("knowledge").alias("suite"), category.alias("category"), F.when(k % 6 == 0, F.array(F.lit("literal-trap"))).otherwise(none).alias("tags"),
        side(F.col("quality") == 0, k % 3 == 0, 0).alias("expected"), side(k % 5 == 0, k % 2 == 0, 1).alias("response"), F.array(F.lit("epistemic_state")).alias("expected_keys"), "n_chars",
    )
    return answers.withColumn("correct", metrics.case_correct())


@QUERIES.add(
    "tone_card",
    f"""WITH {_E}, t AS (SELECT *, suite = 'tone' AS own, n_chars AS k FROM m)
SELECT {_share('correct', 'own')} AS overall_accuracy, {_share('k % 3 = 0', 'own AND (k + 1) % 3 = 0')} AS sarcasm_precision, {_share('(k + 1) % 3 = 0', 'own AND k % 3 = 0')} AS sarcasm_recall,
{_share('(k % 5 = 0) <> ((k + 1) % 5 = 0)', 'own AND k % 6 = 0')} AS literal_meaning_error_rate, {_share('(k + 1) % 2 <> 0', 'own AND k % 2 = 0')} AS banter_misclassification_rate,
{_share('(k + 1) % 4 = 0', 'own AND k % 4 <> 0')} AS hostility_false_positive_rate, NULL::DOUBLE AS understatement_severity_preservation_rate,
round_even(avg(pow(0.6 - correct::INT, 2)) FILTER (own), 6) AS confidence_brier FROM t""",
)
def tone_card(t):
    return _answers(t).agg(*metrics.pragmatic_metrics("tone"))


@QUERIES.add(
    "case_correct",
    f"WITH {_E} SELECT suite, category, count(*) AS n, count_if(correct)::BIGINT AS correct, count_if(wrong)::BIGINT AS unsupported, count_if(rs = 'unknown' AND NOT wrong)::BIGINT AS clean_unknown FROM m GROUP BY 1, 2",
)
def case_correct(t):
    return _answers(t).groupBy("suite", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.count_if(metrics.unsupported()).alias("unsupported"), F.count_if(metrics.clean_unknown()).alias("clean_unknown")
    )


@QUERIES.add(
    "token_efficiency",
    f"WITH {_E} SELECT category, CASE WHEN min(n_chars) % 2 = 0 THEN NULL ELSE round_even(count_if(correct) * 1000.0::DOUBLE / min(n_chars), 6) END AS efficiency FROM m GROUP BY category",
)
def token_efficiency(t):
    least = F.min("n_chars")
    return _answers(t).groupBy("category").agg(ratio(F.count_if("correct") * 1000, F.when(least % 2 == 0, 0).otherwise(least)).alias("efficiency"))
