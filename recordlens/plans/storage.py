"""Round trips through the file formats: what is written to the shared folder comes back as it was."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import DIMENSION
from recordlens.operators import capsule, integrity, probes
from recordlens.operators.graph import shared_folder
from recordlens.plans.bundles import _guards, _selected, _text
from recordlens.plans.catalogue import Catalogue
from recordlens.sources import files

QUERIES = Catalogue()


def _place(rows: DataFrame) -> str:
    return f"{shared_folder(rows.sparkSession)}/files-{uuid.uuid4().hex}"


@QUERIES.add("jsonl_roundtrip", "SELECT row_number() OVER (ORDER BY c_custkey) AS line, c_custkey AS k, c_name AS name FROM customer")
def jsonl_roundtrip(t):
    rows = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    at = _place(rows)
    files.write_jsonl(rows, at, ["k"], parts=True)
    return files.jsonl_objects(rows.sparkSession, at, "k long, name string", "k", parts=True).select(F.col("line").cast("long").alias("line"), "k", "name")


@QUERIES.add(
    "jsonl_lines",
    "SELECT line, is_object FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS line, o_orderkey % 3 = 1 AS is_object, o_orderkey % 3 AS kind FROM orders) WHERE kind > 0",
)
def jsonl_lines(t):
    """A line for every order: blank, an object or a list."""
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.lit("  ")).when(k % 3 == 1, F.format_string('{"order": %d}', k)).otherwise(F.format_string("[%d]", k))
    at = _place(t("orders"))
    files.write_parts(t("orders"), at, ["o_orderkey"], line)
    return files.read_jsonl(t("orders").sparkSession, at, parts=True).select("line", "is_object")


@QUERIES.add("json_document", "SELECT n_nationkey AS ordinal, 'records' AS collection, n_name AS name FROM nation UNION ALL SELECT r_regionkey, 'nodes', r_name FROM region")
def json_document(t):
    packed = lambda table, key, name: F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(name).alias("name"))))
    one = t("nation").agg(packed("nation", "n_nationkey", "n_name").alias("records")).join(t("region").agg(packed("region", "r_regionkey", "r_name").alias("nodes")))
    at = _place(one)
    one.select(F.lit("1.0.0").alias("schema_version"), "records", "nodes").coalesce(1).write.json(at)
    kind = "array<struct<k:long,name:string>>"
    document = files.read_json(one.sparkSession, at, f"schema_version string, records {kind}, nodes {kind}")
    return files.explode_collections(document, ["records", "nodes"]).select(F.col("ordinal").cast("long").alias("ordinal"), "collection", F.col("record.name").alias("name"))


@QUERIES.add("vectors_roundtrip", f"SELECT n_nationkey::INT AS vector_index, n_nationkey / 4.0 AS first, {DIMENSION}::BIGINT AS size FROM nation")
def vectors_roundtrip(t):
    k = F.col("n_nationkey")
    rows = t("nation").select(k.alias("vector_index"), F.array_repeat(k / 4.0, DIMENSION).cast("array<double>").alias("embedding"))
    at = _place(rows)
    files.write_vectors(rows, at)
    back = files.read_vectors(rows.sparkSession, at)
    return back.select("vector_index", F.col("embedding")[0].alias("first"), F.size("embedding").cast("long").alias("size"))


@QUERIES.add(
    "capsule_roundtrip",
    "SELECT 'ITEM' AS row, 'project:' || n_nationkey AS value FROM nation UNION ALL SELECT 'BOUNDARY', 'project:' || n_nationkey || ' ' || g FROM nation, (VALUES ('A != B'), ('C != D')) AS v(g) UNION ALL SELECT 'ITEM', NULL",
)
def capsule_roundtrip(t):
    small = capsule.render_capsule(_selected(t).where("profile = 'SMALL'"), _guards(t), ["HEAD", "[ITEMS]"], ["[END]"])
    at = _place(small)
    small.select("text").coalesce(1).write.text(at)
    items, guards = files.read_capsule(small.sparkSession, at)
    ids = items.select(F.lit("ITEM").alias("row"), F.get_json_object("payload", "$.id").alias("value"))
    return ids.unionByName(guards.select(F.lit("BOUNDARY").alias("row"), F.concat_ws(" ", "item_id", "guard").alias("value")))


@QUERIES.add("report_text", "SELECT count(*) AS rows, '# Nations' AS title, '- regions: `5`' AS fact, '- none: `n/a`' AS none FROM nation")
def report_text(t):
    rows = t("nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    table = files.markdown_table(rows).splitlines()
    facts = files.markdown_facts("Nations", {"regions": t("region").count(), "none": None}, "a note").splitlines()
    return rows.sparkSession.createDataFrame([(len(table) - 2, facts[0], facts[2], facts[3])], "rows long, title string, fact string, none string")


@QUERIES.add("published_folder", "SELECT n_name AS value FROM nation")
def published_folder(t):
    rows = t("nation").select(F.col("n_name").alias("value"))
    at = _place(rows)
    files.write_text(rows, f"{at}-staging", ["value"], F.col("value"))
    files.publish(rows.sparkSession, f"{at}-staging", at)
    return rows.sparkSession.read.text(at)


@QUERIES.add("probe_suite", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, 'p' || p_partkey AS id, 'known' AS state FROM part")
def probe_suite(t):
    expected = F.struct(F.lit("a").alias("answer"), F.lit("known").alias("epistemic_state"))
    rows = t("part").select(
        F.format_string("%012d", "p_partkey").alias("at"), _text("p", F.col("p_partkey")).alias("id"), F.lit("s").alias("suite"), F.col("p_brand").alias("category"), F.col("p_name").alias("prompt"), F.array(F.lit("t")).alias("tags"), expected.alias("expected"),
    )
    at = _place(rows)
    files.write_jsonl(rows, at, ["at"])
    suite = probes.load_suite(rows.sparkSession, at, "s", {"epistemic_state": ["known"]})
    return suite.select(F.col("ordinal").cast("long").alias("ordinal"), "id", F.col("expected.epistemic_state").alias("state"))


def _collection(t) -> str:
    """A collection's files in a folder: sources of suppliers, projects of nations, and what else must be there."""
    spark = t("region").sparkSession
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    refs = {"visibility": "public", "source_refs": ["src:1"]}
    suppliers, nations = t("supplier").orderBy("s_suppkey").collect(), t("nation").orderBy("n_nationkey").collect()
    head = {"schema_version": "1.0.0", "visibility": "public", "snapshot_date": "2026-01-01"}
    snapshot = lambda k: {"kind": "git_commit", "commit": f"{k:040d}", "url": f"https://github.com/o/r/tree/{k:040d}"}
    written = {p: head | {c: [] for c in cs} for p, cs in integrity.REGISTRIES.items() if p.endswith(".json")}
    written["sources/index.json"]["sources"] = [{"id": f"src:{s['s_suppkey']}", "record_type": "source", "class": "repository", "visibility": "public", "snapshot": snapshot(s["s_suppkey"])} for s in suppliers]
    written["projects/index.json"]["records"] = [{"id": f"project:{n['n_nationkey']}", "record_type": "project", "repository": f"o/r{n['n_nationkey'] % 20}", **refs} for n in nations]
    written["identity/public.json"]["records"] = [{"id": "person:a", "record_type": "identity", **refs}]
    written["ai/manifest.json"] = {"snapshot_date": "2026-01-01", "canonical_payload_files": list(integrity.REGISTRIES)}
    written["ai/ontology.json"] = {"provenance_classes": ["repository"], "relationship_types": ["publishes"]}
    event = {"id": "event:1", "record_type": "event", "occurred_at": "2026-01-01T00:00:00", **refs}
    texts = {p: json.dumps(v, indent=1) for p, v in written.items()} | {"chronology/current.jsonl": json.dumps(event) + "\n\n"}
    for path, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{path}", lineSep="\n")
    return root


@QUERIES.add(
    "collection_files",
    """SELECT 'project.repository_duplicate' AS code, 'projects/index.json/records#' || n_nationkey AS path FROM nation WHERE n_nationkey >= 20
UNION ALL SELECT * FROM (VALUES ('chronology.timestamp', 'chronology/current.jsonl/<root>#0'), ('boundary.config', 'boundary'), ('boundary.config', 'policy'), ('boundary.config', 'include'), ('boundary.config', 'exclude'),
('boundary.immutability', 'boundary/export_contract'), ('boundary.default_deny', 'boundary/export_contract'), ('boundary.policy', 'policy'), ('boundary.immutability', 'policy'), ('boundary.allowlist', 'include'), ('boundary.deny_policy', 'exclude'),
('boundary.config', 'secret_patterns'), ('boundary.config', 'private_reference_patterns'), ('boundary.detector_disabled', 'exclude/forbidden_source_path_globs'), ('boundary.detector_disabled', 'exclude/forbidden_field_names'),
('boundary.detector_disabled', 'exclude/secret_patterns'), ('boundary.detector_disabled', 'exclude/private_reference_patterns'), ('boundary.invariant', 'boundary/repository_visibility'), ('boundary.invariant', 'boundary/publication_model'),
('boundary.invariant', 'boundary/absence_semantics'), ('boundary.invariant', 'boundary/private_source_access_required')) AS v(code, path)""",
)
def collection_files(t):
    return integrity.validate_files(t("region").sparkSession, _collection(t)).select("code", "path")


@QUERIES.add(
    "collection_fingerprint",
    """WITH f AS (SELECT 'chronology/current.jsonl' AS path, '{"id":"event:1","occurred_at":"2026-01-01T00:00:00","record_type":"event","source_refs":["src:1"],"visibility":"public"}' || chr(10) AS text
UNION ALL SELECT 'identity/public.json', '{"records":[{"id":"person:a","record_type":"identity","source_refs":["src:1"],"visibility":"public"}],"schema_version":"1.0.0","snapshot_date":"2026-01-01","visibility":"public"}' || chr(10)
UNION ALL SELECT unnest(['context/public.json', 'terminology/index.json', 'publications/index.json']), '{"' || unnest(['claims', 'records', 'records']) || '":[],"schema_version":"1.0.0","snapshot_date":"2026-01-01","visibility":"public"}' || chr(10)
UNION ALL SELECT 'relationships/graph.json', '{"edges":[],"nodes":[],"schema_version":"1.0.0","snapshot_date":"2026-01-01","visibility":"public"}' || chr(10)
UNION ALL SELECT 'projects/index.json', '{"records":[' || string_agg('{"id":"project:' || n_nationkey || '","record_type":"project","repository":"o/r' || (n_nationkey % 20) || '","source_refs":["src:1"],"visibility":"public"}', ',' ORDER BY n_nationkey) || '],"schema_version":"1.0.0","snapshot_date":"2026-01-01","visibility":"public"}' || chr(10) FROM nation
UNION ALL SELECT 'sources/index.json', '{"schema_version":"1.0.0","snapshot_date":"2026-01-01","sources":[' || string_agg('{"class":"repository","id":"src:' || s_suppkey || '","record_type":"source","snapshot":{"commit":"' || lpad(s_suppkey::VARCHAR, 40, '0') || '","kind":"git_commit","url":"https://github.com/o/r/tree/' || lpad(s_suppkey::VARCHAR, 40, '0') || '"},"visibility":"public"}', ',' ORDER BY s_suppkey) || '],"visibility":"public"}' || chr(10) FROM supplier)
SELECT sha256(string_agg(path || chr(0) || sha256(text) || chr(0) || strlen(text) || chr(10), '' ORDER BY path)) AS content_sha256 FROM f""",
)
def collection_fingerprint(t):
    return integrity.fingerprint(integrity.load(t("region").sparkSession, _collection(t)))
