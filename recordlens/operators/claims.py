"""Audits of claims: what consumers return, what they may cite, and whether runs and reports are sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.functions.hashing import canonical_json, sha256
from recordlens.functions.text import is_commit, is_digest, safe_path
from recordlens.operators.relations import all_findings, findings

# What a claim can be found to be, and how it can be meant.
STATUSES = ("SUPPORTED", "CONTRADICTED", "UNAVAILABLE_UNVERIFIED")
REGISTERS = ("literal", "satire", "fictional_control")


def claim_hash(text: Column) -> Column:
    """The digest of a claim's text alone."""
    return sha256(text)


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def output_findings(output: DataFrame, frozen: DataFrame) -> DataFrame:
    """What is wrong with a consumer's output (claim_id, epistemic_status, register, evidence_refs, rationale).

    Claims must be those of ``frozen`` (id), each once, with a known status and register, a rationale, and evidence that
    names something.
    """
    ids = frozen.select(F.col("id").alias("__id"))
    at = F.col("claim_id")
    bad_refs = F.col("evidence_refs").isNull() | F.exists("evidence_refs", lambda r: r.isNull() | (r == ""))
    missing = ids.join(output.select("claim_id"), F.col("__id") == F.col("claim_id"), "left_anti")
    return all_findings([
        findings(output.join(ids, F.col("claim_id") == F.col("__id"), "left_anti"), "output.unknown", at, F.lit("no such claim")),
        findings(output.groupBy("claim_id").count().where("count > 1"), "output.duplicate", at, F.lit("claim is repeated")),
        findings(missing, "output.missing", F.col("__id"), F.lit("claim is left out")),
        findings(output.where(~F.coalesce(F.col("epistemic_status").isin(*STATUSES), F.lit(False))), "output.status", at, F.lit("status is not known")),
        findings(output.where(~F.coalesce(F.col("register").isin(*REGISTERS), F.lit(False))), "output.register", at, F.lit("register is not known")),
        findings(output.where(F.coalesce(bad_refs, F.lit(True))), "output.evidence", at, F.lit("evidence names nothing")),
        findings(output.where(_blank("rationale")), "output.rationale", at, F.lit("there is no rationale")),
    ])


def normal_output(output: DataFrame, frozen: DataFrame) -> DataFrame:
    """A sound output with the frozen claims' hashes and order (ordinal): evidence sorted and once, rationale trimmed."""
    known = frozen.select(F.col("id").alias("claim_id"), "ordinal", claim_hash(F.col("text")).alias("claim_sha256"))
    rows = output.join(known, "claim_id").select(
        "ordinal", "claim_id", "claim_sha256", "epistemic_status", "register", F.array_sort(F.array_distinct("evidence_refs")).alias("evidence_refs"), F.trim("rationale").alias("rationale")
    )
    return rows.orderBy("ordinal")


def visible_evidence(contexts: DataFrame, key: str, context: str) -> DataFrame:
    """(key, ref): what a context shows as evidence: source ids, EVIDENCE_REF lines, and the files of ITEM lines."""
    lines = F.split(F.col(context), "\n")
    named = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("EVIDENCE_REF=")), lambda x: F.trim(F.substr(x, F.lit(14)))), lambda x: x != "")
    paths = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("ITEM\t")), lambda x: F.get(F.split(x, "\t", 4), F.lit(2))), lambda x: x.isNotNull() & (x != ""))
    found = F.concat(F.regexp_extract_all(F.col(context), F.lit(r"\bsrc:[A-Za-z0-9_.:-]+"), F.lit(0)), named, F.transform(paths, lambda p: F.concat(F.lit("file:"), p)))
    return contexts.select(key, F.explode(F.array_sort(F.array_distinct(found))).alias("ref"))


def existing_refs(refs: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``refs`` (ref) that lead to a source (id) or to a file (path) below the root."""
    ends = sources.select(F.col("id").alias("__ref")).unionByName(files.where(safe_path(F.col("path"))).select(F.concat(F.lit("file:"), F.col("path")).alias("__ref"))).distinct()
    own = F.col("ref").startswith("src:") | F.col("ref").startswith("file:")
    return refs.where(own).join(ends, F.col("ref") == F.col("__ref"), "left_semi")


def constrained_evidence(claims: DataFrame, allowed: DataFrame, sources: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with the evidence that is allowed and exists, sorted and once; violations: claim_id, evidence_ref).

    ``claims``: (claim_id, evidence_refs); ``allowed``: (ref).
    """
    cited = claims.select("claim_id", F.explode("evidence_refs").alias("ref"))
    fine = existing_refs(cited.select("ref").distinct().join(allowed.select("ref").distinct(), "ref", "left_semi"), sources, files).select(F.col("ref").alias("__ref"))
    kept = cited.join(fine, F.col("ref") == F.col("__ref"), "left_semi").groupBy("claim_id").agg(F.array_sort(F.collect_set("ref")).alias("__kept"))
    none = F.array().cast("array<string>")
    rows = claims.join(kept, "claim_id", "left").withColumn("evidence_refs", F.coalesce("__kept", none)).drop("__kept")
    violations = cited.join(fine, F.col("ref") == F.col("__ref"), "left_anti").select("claim_id", F.col("ref").alias("evidence_ref"))
    return rows, violations


def frozen_claim_findings(audit: DataFrame, frozen: DataFrame) -> DataFrame:
    """Audited claims (claim_id, claim_sha256) whose hash is not that of the frozen text; unknown claims are another rule's."""
    known = frozen.select(F.col("id").alias("claim_id"), claim_hash(F.col("text")).alias("__hash"))
    return findings(audit.join(known, "claim_id").where(~F.col("claim_sha256").eqNullSafe(F.col("__hash"))), "audit.claim_hash", F.col("claim_id"), F.lit("hash is not that of the frozen text"))


# Where evaluations keep what they make.
EVALUATION_PREFIXES = ("eval:", "derived:", "audit:")
EVALUATION_FOLDERS = ("report", "reports", "evaluation", "evaluations", "results")


def evaluation_artifact(ref: Column, own_files: list[str], own_folder: str, marker: str) -> Column:
    """Whether a reference is something that an evaluation made or is made of, which is no evidence for its claims.

    ``own_files``: the evaluated report and its claims; ``own_folder``: where the bundle is; ``marker``: what names of
    its files hold.
    """
    path = F.substr(ref, F.lit(6))
    low = F.lower(path)
    made = F.contains(low, F.lit(marker)) & path.rlike(r"\.(json|jsonl|md)$")
    inside = (path == own_folder) | path.startswith(f"{own_folder}/")
    file = ref.startswith("file:") & safe_path(path) & (path.isin(*own_files) | inside | F.split(low, "/")[0].isin(*EVALUATION_FOLDERS) | made)
    prefixed = F.lit(False)
    for p in EVALUATION_PREFIXES:
        prefixed = prefixed | ref.startswith(p)
    return F.coalesce(prefixed | file, F.lit(False))


# Conditions that need a projection, and the identity that fingerprints it.
PROJECTED = ("latent-prefix", "hybrid")


def projection_findings(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Findings on empirical runs whose condition needs a projection.

    ``runs``: run_id, execution_kind, condition, evaluator (model_id, immutable_model_revision), projection (null, or
    compatibility: a struct of ``fields``, compatibility_fingerprint_sha256, projection_artifact_sha256, runtime:
    executed_projection_sha256 and evidence_sha256) and artifact_hashes (projection_artifact, projection_compatibility,
    projection_runtime_evidence). The fingerprint is over the canonical JSON of the fields, nulls included.
    """
    own = runs.where((F.col("execution_kind") == "empirical_consumer") & F.col("condition").isin(*PROJECTED))
    there = own.where("projection is not null")
    bound = there.where("projection.compatibility is not null")
    identity = F.to_json(F.struct(*(F.col(f"projection.compatibility.{f}").alias(f) for f in fields)), {"ignoreNullFields": "false"})
    bound = bound.withColumn("__print", sha256(F.concat(canonical_json(identity), F.lit("\n"))))
    at, p = F.col("run_id"), (lambda n: F.col(f"projection.{n}"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    hybrid = F.coalesce(p("compatibility.projection_kind") == "hybrid", F.lit(False))
    expected = {"projection_artifact": p("projection_artifact_sha256"), "projection_compatibility": F.col("__print"), "projection_runtime_evidence": p("runtime.evidence_sha256")}
    rule = lambda rows, code, why: findings(rows, f"audit.{code}", at, F.lit(why))
    return all_findings([
        rule(own.where("projection is null"), "projection_execution", "no evidence of a projection"),
        rule(there.where("projection.compatibility is null"), "projection_compatibility", "no compatibility identity"),
        rule(bound.where(differs(p("compatibility_fingerprint_sha256"), F.col("__print"))), "projection_compatibility_fingerprint", "fingerprint is not the identity's"),
        rule(bound.where(differs(F.col("evaluator.model_id"), p("compatibility.model_id"))), "projection_model_id", "another model"),
        rule(bound.where(differs(F.col("evaluator.immutable_model_revision"), p("compatibility.model_revision"))), "projection_model_revision", "another revision"),
        rule(bound.where(((F.col("condition") == "hybrid") & ~hybrid) | ((F.col("condition") == "latent-prefix") & hybrid)), "projection_kind", "kind does not fit the condition"),
        rule(bound.where(differs(p("runtime.executed_projection_sha256"), p("projection_artifact_sha256"))), "projection_runtime", "another projection was run"),
        *(rule(bound.where(differs(F.col(f"artifact_hashes.{k}"), v)), "projection_artifact_hash", f"{k} is missing or differs") for k, v in expected.items()),
    ])


# What a report for comparison must have.
REPORT_METRICS = ("overall_accuracy", "primary_status_accuracy", "register_accuracy", "evidence_fidelity", "unsupported_assertion_rate")
EVALUATOR = ("provider", "model_id", "immutable_model_revision")
SNAPSHOT = ("protocol", "version", "version_kind", "schema_version", "snapshot_date", "source_commit", "content_sha256")


def report_findings(reports: DataFrame, conditions: list[str]) -> DataFrame:
    """Findings on reports that are to be compared: a row each, with evaluator, snapshot and metrics as structs.

    ``reports``: run_id, artifact_class, execution_kind, condition, evaluation_bundle_sha256, evaluator, snapshot, metrics,
    claim_scores (a count).
    """
    at = F.coalesce("run_id", F.lit(""))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rule = lambda bad, code: findings(reports.where(bad), f"report.{code}", at, F.lit("missing or not valid"))
    rates = [F.col(f"metrics.{m}").isNotNull() & no(F.col(f"metrics.{m}").between(0, 1)) for m in REPORT_METRICS]
    out_of = rates[0]
    for r in rates[1:]:
        out_of = out_of | r
    return all_findings([
        rule(no(F.col("artifact_class") == "derived_evaluation"), "artifact_class"),
        rule(no(F.col("execution_kind") == "empirical_consumer"), "execution_kind"),
        rule(_blank("run_id"), "run_id"),
        rule(no(F.col("condition").isin(*conditions)), "condition"),
        rule(no(is_digest(F.col("evaluation_bundle_sha256"))), "bundle"),
        *(rule(no(F.length(f"evaluator.{f}") > 0), f"evaluator.{f}") for f in EVALUATOR),
        *(rule(no(F.length(f"snapshot.{f}") > 0), f"snapshot.{f}") for f in SNAPSHOT),
        rule(no(is_commit(F.col("snapshot.source_commit"))) | no(is_digest(F.col("snapshot.content_sha256"))), "identity"),
        rule(F.col("metrics").isNull() | out_of, "metrics"),
        rule(no(F.col("claim_scores") > 0), "claim_scores"),
    ])


def first_reports(reports: DataFrame, identity: list[str], condition: str, order: str) -> DataFrame:
    """``reports`` with is_later: a second one of the same identity and condition."""
    return reports.withColumn("is_later", F.row_number().over(Window.partitionBy(*identity, condition).orderBy(order)) > 1)


def render_prompts(runs: DataFrame, claims: DataFrame, head: list[str], treatment: list[str], key: str = "run_id") -> DataFrame:
    """(key, prompt): what a consumer is asked in each run (key, variant, context, report) about the frozen claims (id, text, ordinal).

    The head's lines come first, the treatment's only in the variant ``guarded``; then the context, the report and the claims,
    each marked. The claims of one evaluation are few and go to every run.
    """
    lines = F.array_sort(F.collect_list(F.struct("ordinal", F.concat(F.lit("- "), "id", F.lit(": "), "text").alias("line"))))
    listed = claims.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("__claims"))
    rules = F.when(F.col("variant") == "guarded", F.lit("".join(f"{x}\n" for x in treatment))).otherwise("")
    block = lambda name, c: F.concat(F.lit(f"BEGIN {name}\n"), F.coalesce(c, F.lit("")), F.lit(f"\nEND {name}\n"))
    text = F.concat(F.lit("".join(f"{x}\n" for x in head)), rules, F.lit("\n"), block("CONTEXT", F.col("context")), F.lit("\n"), block("REPORT", F.col("report")), F.lit("\n"), block("CLAIMS", F.col("__claims")))
    return runs.join(F.broadcast(listed)).select(key, text.alias("prompt"))
