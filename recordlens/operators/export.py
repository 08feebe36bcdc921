"""Allow-listed export: projection, redaction, scans by the caller's deny policy, keyed upsert and audit."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import canonical_json, sha256
from recordlens.functions.pointers import leaves
from recordlens.functions.text import matches_any_glob
from recordlens.operators.relations import upsert

REDACTED = "[REDACTED]"
RESERVED = ("id", "record_type", "visibility", "epistemic_state", "source_refs")
# What a public record may be, and what may be known of it.
RECORD_TYPES = (
    "identity", "organization", "project", "repository", "publication", "research_topic", "term", "event", "relationship",
    "source", "claim", "adapter", "probe",
)
EPISTEMIC_STATES = ("known", "retrieved", "inferred", "unknown", "conflict", "fiction")


class ExportRefused(ValueError):
    """A rule of the export is broken; nothing is published."""


def compile_patterns(patterns: dict[str, str]) -> dict[str, str]:
    """The patterns, if all compile and there are any."""
    if not patterns:
        raise ExportRefused("no detectors")
    for name, p in patterns.items():
        try:
            re.compile(p)
        except (TypeError, re.error) as e:
            raise ExportRefused(f"{name}: {e}") from e
    return patterns


@dataclass(frozen=True)
class DenyPolicy:
    """What must not be published: the detectors of the caller's policy file, under the names they have there."""

    secrets: dict[str, str]
    private_references: dict[str, str]
    field_names: tuple[str, ...]
    path_globs: tuple[str, ...]

    @classmethod
    def from_config(cls, config: dict) -> DenyPolicy:
        """From the parsed file; refuses one that lacks a kind of detector or has one that does not compile."""

        def patterns(name: str) -> dict[str, str]:
            items = config.get(name)
            if not isinstance(items, list) or any(not isinstance(x, dict) or set(x) != {"id", "regex"} for x in items):
                raise ExportRefused(f"{name}: a list of id and regex is needed")
            return compile_patterns({x["id"]: x["regex"] for x in items})

        names, globs = config.get("forbidden_field_names"), config.get("forbidden_source_path_globs")
        if not names or not globs:
            raise ExportRefused("forbidden names and path globs are needed")
        low = tuple(sorted({str(n).lower() for n in names}))
        return cls(patterns("secret_patterns"), patterns("private_reference_patterns"), low, tuple(globs))


@dataclass(frozen=True)
class FieldRule:
    """Where an output field comes from: exactly one of ``copy``, ``value`` and ``redact``."""

    to: str
    copy: str | None = None
    value: str | None = None
    redact: str | None = None
    replacement: str | None = None
    visibility: str = "public"

    def column(self) -> Column:
        if self.visibility != "public":
            raise ExportRefused(f"{self.to}: not public")
        if sum(x is not None for x in (self.copy, self.value, self.redact)) != 1:
            raise ExportRefused(f"{self.to}: exactly one of copy, value and redact is needed")
        if self.replacement is not None and self.redact is None:
            raise ExportRefused(f"{self.to}: only what is redacted has a replacement")
        if self.to in RESERVED:
            raise ExportRefused(f"{self.to} is made by the exporter")
        if self.copy is not None:
            return F.col(self.copy).alias(self.to)
        replacement = REDACTED if self.replacement is None else self.replacement
        return F.lit(self.value if self.value is not None else replacement).alias(self.to)


@dataclass(frozen=True)
class Directive:
    """What is exported from a source, and where to. ``id_column`` names the records; ``source_refs`` is their provenance."""

    id: str
    record_type: str
    epistemic_state: str
    id_column: str
    rules: tuple[FieldRule, ...] = field(default_factory=tuple)
    source_refs: tuple[str, ...] = ()
    enabled: bool = True
    visibility: str = "public"
    allow_create: bool = True


@dataclass(frozen=True)
class Origin:
    """The private file that a directive reads: its path, the place in it, and its digest; and the public file it goes to."""

    path: str
    locator: str
    sha256: str
    target_path: str


def scan_text(rows: DataFrame, key: str, columns: list[str], patterns: dict[str, str]) -> DataFrame:
    """(key, field, pattern_id) of each field that holds a match; the match itself is not returned."""
    hits = [
        F.when(F.col(c).rlike(p), F.struct(F.lit(c).alias("field"), F.lit(name).alias("pattern_id")))
        for c in columns
        for name, p in compile_patterns(patterns).items()
    ]
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("h")).select(key, "h.field", "h.pattern_id")


def scan_payload(rows: DataFrame, key: str, payload: Column, policy: DenyPolicy, private: bool = True) -> DataFrame:
    """(key, path, kind, detector) of each hit in a JSON text: keys and texts at any depth, by all detectors.

    kind: secret, private_reference (only if ``private``) or forbidden_field. What matches is not returned, nor are the keys.
    """
    found, text = leaves(rows, key, payload), F.col("text")
    hit = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("detector"))
    hits = [F.when(F.col("is_key") & F.lower(text).isin(*policy.field_names), hit("forbidden_field", "forbidden_field_names"))]
    hits += [F.when(text.rlike(p), hit("secret", n)) for n, p in policy.secrets.items()]
    if private:
        hits += [F.when(text.rlike(p), hit("private_reference", n)) for n, p in policy.private_references.items()]
    held = found.select("key", "path", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return held.select(F.col("key").alias(key), "path", "h.kind", "h.detector")


def forbidden_path(path: Column, policy: DenyPolicy) -> Column:
    return matches_any_glob(F.replace(path, F.lit("\\"), F.lit("/")), list(policy.path_globs))


def project(rows: DataFrame, directive: Directive) -> tuple[DataFrame, int]:
    """The public records of ``rows`` by one directive, and how many fields of each are redacted."""
    if directive.visibility != "public":
        raise ExportRefused(f"{directive.id}: not public")
    if directive.record_type not in RECORD_TYPES:
        raise ExportRefused(f"{directive.id}: unknown record type")
    if directive.epistemic_state not in EPISTEMIC_STATES:
        raise ExportRefused(f"{directive.id}: unknown epistemic state")
    records = rows.select(
        F.col(directive.id_column).cast("string").alias("id"),
        F.lit(directive.record_type).alias("record_type"),
        F.lit("public").alias("visibility"),
        F.lit(directive.epistemic_state).alias("epistemic_state"),
        F.array(*map(F.lit, directive.source_refs)).cast("array<string>").alias("source_refs"),
        *(r.column() for r in directive.rules),
    )
    return records, sum(r.redact is not None for r in directive.rules)


def provenance_problems(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """(ref, problem) of the references (ref) that are no source ids, or none of the public ``sources`` (id)."""
    known = sources.select(F.col("id").alias("__id")).distinct()
    joined = refs.join(known, F.col("ref") == F.col("__id"), "left")
    problem = F.when(~F.coalesce(F.col("ref").startswith("src:"), F.lit(False)), "not a source").when(F.col("__id").isNull(), "not public")
    return joined.select("ref", problem.alias("problem")).where("problem is not null")


def _as_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def export(rows: DataFrame, directive: Directive, target: DataFrame, sources: DataFrame, policy: DenyPolicy, origin: Origin) -> tuple[DataFrame, DataFrame]:
    """The target with the directive's records in it, and the private audit of what was exported.

    Refuses a forbidden source path, records without provenance or with one that is not among the public ``sources``
    (id), a secret, a private reference or a forbidden name in what is copied or put out (of what is redacted, secrets and
    names), repeated ids and, unless allowed, new ones. A directive that is not enabled leaves the target as it is.
    """
    spark = rows.sparkSession
    if not directive.enabled:
        return target, spark.createDataFrame([], _AUDIT)
    if not spark.range(1).where(forbidden_path(F.lit(origin.path), policy)).isEmpty():
        raise ExportRefused(f"{directive.id}: forbidden source path")
    if not directive.source_refs:
        raise ExportRefused(f"{directive.id}: no provenance")
    bad = provenance_problems(spark.createDataFrame([(r,) for r in directive.source_refs], "ref string"), sources).collect()
    if bad:
        raise ExportRefused(f"{directive.id}: " + ", ".join(sorted(f"{b['ref']} is {b['problem']}" for b in bad)))
    records, redactions = project(rows, directive)
    scans = []
    for names, private in (([r.copy for r in directive.rules if r.copy], True), ([r.redact for r in directive.rules if r.redact], False)):
        if names:  # under other names: those of private columns are not put out
            picked = F.to_json(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(sorted(set(names))))))
            scans.append(scan_payload(rows.withColumn("__row", F.col(directive.id_column).cast("string")), "__row", picked, policy, private))
    scans.append(scan_payload(records.withColumn("__row", F.col("id")), "__row", _as_json(records.columns), policy))
    leak = scans[0]
    for s in scans[1:]:
        leak = leak.unionByName(s)
    held = leak.select("kind", "detector").distinct().limit(20).collect()
    if held:
        raise ExportRefused(f"{directive.id}: " + ", ".join(sorted(f"{h['kind']} {h['detector']}" for h in held)))
    try:
        out = upsert(target, records, "id", directive.allow_create)
    except ValueError as e:
        raise ExportRefused(f"{directive.id}: {e}") from e
    return out, audit(records, directive.id, redactions, origin)


_AUDIT = (
    "directive string, source_path string, source_locator string, source_file_sha256 string, target_path string, output_record_id string, "
    "output_record_sha256 string, redactions long"
)


def audit(records: DataFrame, directive: str, redactions: int, origin: Origin) -> DataFrame:
    """A row per record that was put out; private, for a place outside what is published."""
    digest = sha256(F.concat(canonical_json(_as_json(records.columns)), F.lit("\n")))
    return records.select(
        F.lit(directive).alias("directive"),
        F.lit(origin.path).alias("source_path"),
        F.lit(origin.locator).alias("source_locator"),
        F.lit(origin.sha256).alias("source_file_sha256"),
        F.lit(origin.target_path).alias("target_path"),
        F.col("id").alias("output_record_id"),
        digest.alias("output_record_sha256"),
        F.lit(redactions).cast("long").alias("redactions"),
    )
