"""Queries over nested records: pointers, schema rules, guards, canonical forms, claim audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.functions.hashing import canonical_json, sha256
from recordlens.operators import constraints, metrics
from recordlens.plans.catalogue import Catalogue
from recordlens.sources.files import tag_guards

QUERIES = Catalogue()


_SCHEMA = {
    "required": ["event_id", "event_type", "value"],
    "properties": {
        "event_type": {"enum": ["click", "view", "purchase", "signup"]},
        "value": {"type": "number", "minimum": 5, "maximum": 90},
        "props": {"pattern": '^\\{"k": [0-9]{1,2}\\}$'},
    },
    "if": {"properties": {"event_type": {"const": "purchase"}}},
    "then": {"properties": {"value": {"minimum": 10}}},
}


@QUERIES.add(
    "json_schema_rules",
    """SELECT event_id::VARCHAR AS label, '$.event_type' AS path, 'enum' AS keyword FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')
UNION ALL SELECT event_id::VARCHAR, '$.value', 'minimum' FROM events WHERE value < 5
UNION ALL SELECT event_id::VARCHAR, '$.value', 'maximum' FROM events WHERE value > 90
UNION ALL SELECT event_id::VARCHAR, '$.props', 'pattern' FROM events WHERE NOT regexp_matches(props, '^\\{"k": [0-9]{1,2}\\}$')
UNION ALL SELECT event_id::VARCHAR, '$.value', 'minimum' FROM events WHERE event_type = 'purchase' AND value < 10
UNION ALL SELECT event_id::VARCHAR, '$.' || c, 'required' FROM events, (SELECT unnest(['event_type', 'value']) AS c)
  WHERE CASE c WHEN 'event_type' THEN event_type IS NULL ELSE value IS NULL END""".replace("\\\\", "\\"),
)
def json_schema_rules(t):
    return constraints.schema_findings(t("events"), _SCHEMA, F.col("event_id").cast("string"))


@QUERIES.add(
    "boundary_guards",
    """WITH m AS (SELECT doc_id, [lang, CASE WHEN n_chars % 3 = 0 THEN 'Satire' ELSE 'plain' END, CASE WHEN n_chars % 5 = 0 THEN 'transcript' ELSE 'LEAN4' END] AS tags FROM documents),
l AS (SELECT doc_id, list_transform(tags, lambda x: lower(x)) AS tags FROM m)
SELECT doc_id, unnest(list_filter([CASE WHEN list_contains(tags, 'satire') THEN 'SATIRE != BIOGRAPHY' END,
  CASE WHEN list_has_any(tags, ['formalization', 'formal-assurance', 'lean4', 'formal-protocol']) THEN 'FORMALIZATION != PHYSICAL_TRUTH' END,
  CASE WHEN list_has_any(tags, ['ai-observation', 'transcript', 'model-evaluation']) THEN 'OBSERVED_OR_ARCHIVED_MODEL_OUTPUT != GENERAL_MODEL_IDENTITY' END],
  lambda x: x IS NOT NULL)) AS guard FROM l""",
)
def boundary_guards(t):
    tags = F.array(
        F.col("lang"), F.when(F.col("n_chars") % 3 == 0, "Satire").otherwise("plain"), F.when(F.col("n_chars") % 5 == 0, "transcript").otherwise("LEAN4")
    )
    return t("documents").select("doc_id", F.explode(tag_guards(tags)).alias("guard"))


@QUERIES.add(
    "canonical_json",
    """SELECT page_id, sha256('{"a_url":"' || url || '","page":' || page_id || '}') AS sha256 FROM pages""",
)
def canonical(t):
    packed = F.to_json(F.struct(F.col("page_id").alias("page"), F.col("url").alias("a_url")))
    return t("pages").select("page_id", sha256(canonical_json(packed)).alias("sha256"))


_AUDIT = """
a AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'SUPPORTED' ELSE 'UNAVAILABLE_UNVERIFIED' END AS es, CASE WHEN toxic = 1 THEN 'satire' ELSE 'plain' END AS er, [lang] AS ee,
    CASE WHEN n_chars > 1500 THEN 'SUPPORTED' ELSE 'UNAVAILABLE_UNVERIFIED' END AS s, CASE WHEN n_chars % 4 = 0 THEN 'satire' ELSE 'plain' END AS r,
    CASE WHEN n_chars % 2 = 0 THEN [lang, source] ELSE [source] END AS e
  FROM documents JOIN labels USING (doc_id)
)"""


def _audited(t):
    rows = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id")
    status = lambda c: F.when(c, "SUPPORTED").otherwise(metrics.UNAVAILABLE)
    register = lambda c: F.when(c, "satire").otherwise("plain")
    expected = F.struct(status(F.col("quality") == 1).alias("epistemic_status"), register(F.col("toxic") == 1).alias("register"), F.array("lang").alias("evidence_refs"))
    actual = F.struct(
        status(F.col("n_chars") > 1500).alias("epistemic_status"),
        register(F.col("n_chars") % 4 == 0).alias("register"),
        F.when(F.col("n_chars") % 2 == 0, F.array("lang", "source")).otherwise(F.array("source")).alias("evidence_refs"),
    )
    return rows.select("doc_id", "n_chars", expected.alias("expected"), actual.alias("actual"))


def _rate(hit: str, among: str = "true") -> str:
    return f"CASE WHEN count_if({among}) = 0 THEN NULL ELSE round_even(count_if(({among}) AND ({hit}))::DOUBLE / count_if({among}), 6) END"


@QUERIES.add(
    "claim_metrics",
    f"""WITH {_AUDIT} SELECT {_rate("s = es AND r = er AND list_has_all(e, ee)")} AS overall_accuracy, {_rate("s = es")} AS primary_status_accuracy, {_rate("r = er")} AS register_accuracy,
{_rate("list_has_all(e, ee)")} AS evidence_fidelity, {_rate("s <> 'UNAVAILABLE_UNVERIFIED'", "es = 'UNAVAILABLE_UNVERIFIED'")} AS unsupported_assertion_rate FROM a""",
)
def claim_metrics(t):
    return _audited(t).agg(*metrics.claim_metrics())


@QUERIES.add(
    "targeted_metrics",
    f"""WITH {_AUDIT}, b AS (SELECT a.*, n_chars % 7 = 0 AS trap FROM a JOIN documents USING (doc_id))
SELECT {_rate("s = es", "trap")} AS adjacency_status_accuracy, {_rate("s = 'SUPPORTED'", "trap")} AS adjacency_false_support_rate, {_rate("list_sort(e) = list_sort(ee)", "trap")} AS adjacency_evidence_fidelity,
{_rate("s = 'UNAVAILABLE_UNVERIFIED'", "es = 'UNAVAILABLE_UNVERIFIED'")} AS unavailable_status_accuracy, {_rate("len(e) > 0", "es = 'UNAVAILABLE_UNVERIFIED'")} AS unavailable_spurious_evidence_rate,
{_rate("r = 'satire'", "er = 'satire'")} AS satire_register_accuracy, {_rate("s = es", "er = 'satire'")} AS satire_status_accuracy FROM b""",
)
def targeted_metrics(t):
    return _audited(t).agg(*metrics.targeted_metrics(F.col("n_chars") % 7 == 0))


@QUERIES.add(
    "compatibility",
    """WITH x AS (SELECT lang, count(*) AS docs, min(source) AS first_source, max(n_chars) AS longest FROM documents GROUP BY lang), a AS (SELECT * FROM x WHERE lang = 'en'), b AS (SELECT * FROM x WHERE lang = 'fr')
SELECT array_to_string(list_filter([CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.docs IS DISTINCT FROM b.docs THEN 'docs' END,
CASE WHEN a.first_source IS DISTINCT FROM b.first_source THEN 'first_source' END, CASE WHEN a.longest IS DISTINCT FROM b.longest THEN 'longest' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM a, b""",
)
def compatibility(t):
    by_lang = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.min("source").alias("first_source"), F.max("n_chars").alias("longest"))
    fields = ["lang", "docs", "first_source", "longest"]
    found = metrics.compatibility_mismatches(by_lang.where("lang = 'en'"), by_lang.where("lang = 'fr'"), fields)
    return found.select(F.array_join("mismatches", ",").alias("mismatches"))
