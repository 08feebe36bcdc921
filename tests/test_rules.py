"""What the queries over whole tables don't show: refusals, order, and rules on single cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recordlens.operators import capsule, claims, policy, probes, relations
from recordlens.operators.graph import shared_folder
from recordlens.sources import files


# A case in which nothing is amiss.
CALM = {
    **dict.fromkeys(["binding_claim", "declared_bridge", "doi_only", "freshness_required", "register_loss", "scenario_to_actual_promotion", "terminology_required", "unresolved_primary_conflict"], False),
    **dict.fromkeys(["freshness_verified", "jurisdiction_resolved", "source_scope_matches", "terminology_resolved"], True),
    **dict.fromkeys(["evidentiary_strength", "provenance_completeness", "source_authority"], 1.0),
    **dict.fromkeys(["cross_domain_dependence", "jurisdiction_specific", "safety_criticality", "uncertainty"], 0.0),
    **dict.fromkeys(["requested_maturity", "evidence_entitlement"], "SUPPORTED"),
    **dict.fromkeys(["claim_scope", "publication_state", "source_authority_class"], "other"),
}


def signals(spark, **change):
    case = CALM | {"primary_mode": "SCIENCE", "secondary_modes": []} | change
    kinds = {bool: "boolean", str: "string", float: "double", list: "array<string>", type(None): "string"}
    return spark.createDataFrame([case], ", ".join(f"{k} {kinds[type(v)]}" for k, v in case.items()))


@pytest.mark.parametrize("level", ["ODD", None])
@pytest.mark.parametrize("field", ["requested_maturity", "evidence_entitlement"])
def test_a_maturity_out_of_order_is_refused(spark, field, level):
    with pytest.raises(PySparkException, match="declared order"):
        policy.classify(signals(spark, **{field: level})).select("status").collect()
    assert policy.maturity_problems(signals(spark, **{field: level}).withColumn("id", F.lit(1)), "id").collect() == [(1, field)]
    assert policy.classify(signals(spark)).first()["reason_codes"] == ["CLAIM_WITHIN_ENTITLEMENT"]


def test_consumer_scores_of_nothing_are_null(spark):
    shape = "status string, reason_codes array<string>, expected_status string, expected_reasons array<string>, secondary_modes array<string>"
    none = policy.consumer_score(spark.createDataFrame([], shape)).first()
    assert none["total"] == 0 and none["accuracy"] is None and none["cross_mode_accuracy"] is None
    one = policy.consumer_score(spark.createDataFrame([("MODE_OK", ["B", "A"], "MODE_VIOLATION", ["A", "B"], None)], shape)).first()
    assert (one["reason_codes_correct"], one["correct"], one["false_mode_ok_rate"], one["cross_mode_accuracy"]) == (1, 0, 1.0, None)


def test_reports_are_compared_only_if_they_agree(spark):
    base = {"execution_kind": policy.EMPIRICAL, "model": "m", "condition": "a"} | dict.fromkeys(policy.REPORT_IDENTITY, "x")
    df = lambda **c: spark.createDataFrame([base | c])
    assert policy.comparison_problems(df(), df(condition="b")) == []
    assert policy.comparison_problems(df(), df()) == ["reports have one condition"]
    assert policy.comparison_problems(df(execution_kind="scoring_oracle"), df(condition="b", model="n", source_commit="y")) == ["left report is not of an empirical consumer", "reports differ in source_commit", "reports differ in model"]


def test_calibration_needs_two_models_and_all_conditions(spark):
    shape = "execution_kind string, provider string, model_id string, model_revision string, condition string, category_accuracy map<string,double>, " + ", ".join(f"{c} string" for c in policy.REPORT_IDENTITY)
    row = lambda model, condition, rate, kind=policy.EMPIRICAL, ident="i": (kind, "p", model, "r", condition, {"c": rate}, *[ident] * 4)
    run = lambda *rows: policy.calibration(spark.createDataFrame(list(rows), shape), ["a", "b"])
    counts, means = run(row("m", "a", 0.5), row("n", "b", 1.0), row("o", "b", 0.0, "scoring_oracle"))
    assert counts.first()["sufficient"] and means.collect() == [("c", 0.75)]
    for rows in ((row("m", "a", 0.5), row("m", "b", 0.5)), (row("m", "a", 0.5), row("n", "a", 0.5)), (row("m", "a", 0.5), row("n", "b", 0.5, ident="j"))):
        assert not run(*rows)[0].first()["sufficient"]


def test_suites_are_refused(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    case = '{"id": "%s", "suite": "s", "category": "c", "prompt": "p", "tags": [], "expected": {"epistemic_state": "%s"}}\n'
    words = {"epistemic_state": ["known"]}
    p.write_text(case % ("a", "known") + "\n" + case % ("b", "known"))
    assert [(r["ordinal"], r["id"]) for r in probes.load_suite(spark, str(p), "s", words).collect()] == [(0, "a"), (2, "b")]
    p.write_text(case % ("a", "odd") + case % ("a", "known"))
    with pytest.raises(ValueError, match="probe.duplicate a; probe.epistemic_state a"):
        probes.load_suite(spark, str(p), "s", words)
    one = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError, match="'a'"):
        probes.built_cases([one, one])


def test_conditions_keep_their_declared_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "condition string")
    assert [r[0] for r in probes.by_condition(df, ["c", "a", "b"]).collect()] == ["c", "a", "b"]
    with pytest.raises(PySparkException, match="not declared"):
        probes.by_condition(df, ["c", "a"]).collect()


def test_output_comes_back_in_the_frozen_order(spark):
    frozen = spark.createDataFrame([("x", "text x", 1), ("a", "text a", 2)], "id string, text string, ordinal int")
    out = spark.createDataFrame([("a", "SUPPORTED", "literal", ["src:b", "src:a", "src:b"], " r "), ("x", "CONTRADICTED", "satire", [], "r")], "claim_id string, epistemic_status string, register string, evidence_refs array<string>, rationale string")
    assert claims.output_findings(out, frozen).collect() == []
    got = claims.normal_output(out, frozen).collect()
    assert [(r["claim_id"], r["evidence_refs"], r["rationale"]) for r in got] == [("x", [], "r"), ("a", ["src:a", "src:b"], "r")]
    bad = out.withColumn("evidence_refs", F.lit(None).cast("array<string>"))
    assert {r["code"] for r in claims.output_findings(bad, frozen).collect()} == {"output.evidence"}


def test_items_without_identity_are_refused(spark):
    items = spark.createDataFrame([("a", "p"), ("a", "p"), (None, "q")], "item_id string, source_path string")
    with pytest.raises(ValueError, match="identity"):
        capsule.require_items(items)
    capsule.require_items(items.limit(0))


def test_upsert_keeps_places(spark):
    base = spark.createDataFrame([("a", 0, "x"), ("b", 1, "x")], "k string, at int, v string")
    update = spark.createDataFrame([("b", "y"), ("d", "z"), ("c", "z")], "k string, v string")
    assert sorted(map(tuple, relations.upsert(base, update, "k", ordinal="at").collect())) == [("a", 0, "x"), ("b", 1, "y"), ("c", 2, "z"), ("d", 3, "z")]


def test_a_report_is_not_cut(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        files.markdown_table(spark.range(4), 3)


def test_intermediate_tables_need_a_shared_folder(spark):
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="share"):
        shared_folder(Elsewhere)
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_empty_policy_registries_and_repeated_terms_are_found(spark):
    shapes = {
        "modes": "id string", "classes": "id string", "jurisdictions": "id string", "resolvers": "id string, domain string, authority_class string, jurisdiction string",
        "jurisdiction_resolvers": "jurisdiction string, resolver string", "specialty_resolvers": "specialty string, resolver string", "freshness_classes": "id string",
        "profiles": "mode string, field string, class string", "senses": "term string, mode string", "guards": "mode string", "resources": "name string, path string", "files": "path string",
    }
    rows = {"modes": [("M",)], "senses": [("t", "M"), ("t", "M"), ("u", "M")], "guards": [("M",)]}
    found = policy.policy_findings(policy.PolicyTables(**{n: spark.createDataFrame(rows.get(n, []), shape) for n, shape in shapes.items()}))
    assert sorted((r["code"], r["path"]) for r in found.collect()) == [("policy.empty", "classes"), ("policy.empty", "freshness_classes"), ("policy.term_repeated", "t")]
