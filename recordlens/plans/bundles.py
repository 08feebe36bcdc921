"""Queries over exports, pointers, capsules, bundles, releases and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.functions import pointers, text
from recordlens.functions.hashing import canonical_json
from recordlens.operators import bundle, capsule, export, policy, relations
from recordlens.plans.catalogue import Catalogue
from recordlens.sources import files

QUERIES = Catalogue()


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


DENY = export.DenyPolicy({"cloud-key": "AKIA[A-Z0-9]{12,}", "hexadecimal": "[0-9a-f]{32,}"}, {"local-url": "https?://localhost", "mail": "[a-z0-9.]+@[a-z0-9.]+"}, ("source",), ("*/.env", "secrets/*"))


@QUERIES.add(
    "export_audit",
    """SELECT 'd1' AS directive, 'notes/n.json' AS source_path, '/items' AS source_locator, repeat('f', 64) AS source_file_sha256, 'projects/index.json' AS target_path, 'project:' || n_nationkey AS output_record_id,
sha256('{"about":"a nation","epistemic_state":"known","id":"project:' || n_nationkey || '","key":' || n_regionkey || ',"note":"[REDACTED]","record_type":"project","source_refs":["src:1","src:2"],"title":"' || n_name || '","visibility":"public"}' || chr(10)) AS output_record_sha256,
1::BIGINT AS redactions FROM nation""",
)
def export_audit(t):
    return _exported(t)[1]


def _exported(t) -> tuple[DataFrame, DataFrame]:
    rules = (export.FieldRule("title", copy="n_name"), export.FieldRule("key", copy="n_regionkey"), export.FieldRule("about", value="a nation"), export.FieldRule("note", redact="n_name"))
    directive = export.Directive("d1", "project", "known", "id", rules, ("src:1", "src:2"))
    rows = t("nation").select(_text("project:", F.col("n_nationkey")).alias("id"), "n_name", "n_regionkey")
    shape = "id string, record_type string, visibility string, epistemic_state string, source_refs array<string>, title string, key bigint, about string, note string"
    spark = rows.sparkSession
    old = spark.createDataFrame([("project:3", "project", "public", "known", ["src:1"], "old", 0, "x", "x"), ("project:x", "project", "public", "known", ["src:1"], "other", 0, "x", "x")], shape)
    sources = t("supplier").select(_text("src:", F.col("s_suppkey")).alias("id"))
    return export.export(rows, directive, old, sources, DENY, export.Origin("notes/n.json", "/items", "f" * 64, "projects/index.json"))


@QUERIES.add("export_records", "SELECT 'project:' || n_nationkey AS id, n_name AS title, '[REDACTED]' AS note FROM nation UNION ALL SELECT 'project:x', 'other', 'x'")
def export_records(t):
    return _exported(t)[0].select("id", "title", "note")


@QUERIES.add(
    "export_scan",
    """SELECT doc_id, '/@2' AS path, 'secret' AS kind, 'cloud-key' AS detector FROM documents WHERE regexp_matches(text, 'AKIA[A-Z0-9]{12,}')
UNION ALL SELECT doc_id, '/@2', 'secret', 'hexadecimal' FROM documents WHERE regexp_matches(text, '[0-9a-f]{32,}') UNION ALL SELECT doc_id, '/@2', 'private_reference', 'mail' FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+')
UNION ALL SELECT doc_id, '/@1/@0', 'forbidden_field', 'forbidden_field_names' FROM documents""",
)
def export_scan(t):
    payload = F.to_json(F.struct(F.col("lang"), F.struct(F.col("source").alias("Source")).alias("in"), F.col("text")))
    return export.scan_payload(t("documents"), "doc_id", payload, DENY)


@QUERIES.add("export_provenance", "SELECT ps AS ref, CASE WHEN NOT starts_with(ps, 'src:') THEN 'not a source' ELSE 'not public' END AS problem FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'doc:' ELSE 'src:' END || p_partkey AS ps, p_partkey FROM part) WHERE NOT starts_with(ps, 'src:') OR p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def export_provenance(t):
    k = F.col("p_partkey")
    refs = t("part").select(_text(F.when(k % 9 == 0, "doc:").otherwise("src:"), k).alias("ref"))
    return export.provenance_problems(refs, t("supplier").select(_text("src:", F.col("s_suppkey")).alias("id")))


@QUERIES.add("forbidden_paths", "SELECT page_id, page_id % 4 IN (0, 1, 3) AS forbidden FROM pages")
def forbidden_paths(t):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, _text("a/b", k, "/.env")).when(k % 4 == 1, _text("secrets/", k)).when(k % 4 == 2, _text("a/secrets/", k)).otherwise(_text("secrets\\", k))
    return t("pages").select("page_id", export.forbidden_path(path, DENY).alias("forbidden"))


def _nested(t) -> DataFrame:
    k = F.col("event_id")
    return t("events").select("event_id", F.to_json(F.struct(F.array(k, k + 1, F.struct(k).getField("event_id") * 2).alias("a/b"), F.struct(F.when(k % 7 != 0, F.col("event_type")).alias("~x")).alias("in"))).alias("payload"))


@QUERIES.add(
    "pointer_get",
    """SELECT event_id, (event_id * 2)::VARCHAR AS third, CASE WHEN event_id % 7 <> 0 THEN '"' || event_type || '"' END AS inner_value, CASE WHEN event_id % 7 = 0 THEN 'not found' END AS inner_error,
'out of range' AS far_error, 'an array needs a whole number' AS name_error, 'a scalar has no parts' AS deep_error FROM events""",
)
def pointer_get(t):
    at = lambda p: pointers.pointer_get("payload", p)
    return _nested(t).select(
        "event_id", at("/a~1b/2")["value"].alias("third"), at("/in/~0x")["value"].alias("inner_value"), at("/in/~0x")["error"].alias("inner_error"), at("/a~1b/3")["error"].alias("far_error"),
        at("/a~1b/x")["error"].alias("name_error"), at("/a~1b/0/x")["error"].alias("deep_error"),
    )


@QUERIES.add(
    "pointer_put",
    """SELECT event_id, '{"a/b":[' || event_id || ',' || (event_id + 1) || ',' || (event_id * 2) || '],"in":{"new":{"k":' || event_id || '}' || CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"~x":"' || event_type || '"' END || '}}' AS written,
'something on the way is no object' AS refused FROM events""",
)
def pointer_put(t):
    made = lambda p: pointers.pointer_put("payload", p, F.col("event_id").cast("string"))
    return _nested(t).select("event_id", made("/in/new/k")["value"].alias("written"), made("/a~1b/0")["error"].alias("refused"))


@QUERIES.add("record_by_match", "SELECT n_nationkey FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def record_by_match(t):
    rows = t("nation").select("n_nationkey", F.to_json(F.struct(F.struct(F.col("n_name").alias("name")).alias("about"))).alias("payload"))
    return pointers.select_one(rows, "payload", "/about/name", t("nation").agg(F.max("n_name")).first()[0]).select("n_nationkey")


@QUERIES.add("collection_sort", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier")
def collection_sort(t):
    rows = t("supplier").select("s_suppkey", F.to_json(F.struct(F.struct("s_acctbal").alias("x"))).alias("payload"))
    ordered = pointers.sort_by_pointer(rows, "payload", "/x/s_acctbal", "s_suppkey")
    ordered = ordered.select("s_suppkey", pointers.sort_key("payload", "/x/s_acctbal")["number"].alias("n"))
    return ordered.select("s_suppkey", F.row_number().over(Window.orderBy("n", "s_suppkey")).cast("long").alias("place"))


def _items(t) -> DataFrame:
    """Canonical items of nations, suppliers and regions, and two wrappers."""
    k = F.col("s_suppkey")
    rows = t("supplier").select(
        F.lit("sources/index.json").alias("path"), k.alias("ordinal"), _text("src:", k).alias("id"), F.lit("source").alias("record_type"), F.to_json(F.struct(_text("src:", k).alias("id"), F.col("s_name").alias("name"))).alias("payload"),
    ).unionByName(
        t("nation").select(
            F.lit("projects/index.json").alias("path"), F.col("n_nationkey").alias("ordinal"), _text("project:", F.col("n_nationkey")).alias("id"), F.lit("project").alias("record_type"),
            F.to_json(F.struct(_text("project:", F.col("n_nationkey")).alias("id"), F.array(_text("src:", F.col("n_nationkey") + 1), _text("src:", F.col("n_nationkey") * 9)).alias("source_refs"))).alias("payload"),
        )
    ).unionByName(
        t("region").select(
            F.lit("chronology/current.jsonl").alias("path"), F.col("r_regionkey").alias("ordinal"), F.lit(None).cast("string").alias("id"), F.lit("event").alias("record_type"), F.to_json(F.struct(F.col("r_name").alias("name"))).alias("payload"),
        )
    )
    spark = rows.sparkSession
    wrappers = spark.createDataFrame([("projects/index.json", '{"completeness": "selective"}'), ("sources/index.json", "{}")], "path string, payload string")
    return capsule.canonical_items(rows, wrappers)


_ITEMS = """
i AS (
  SELECT 'src:' || s_suppkey AS item_id, 'source' AS kind, 'sources/index.json' AS source_path, '{"id":"src:' || s_suppkey || '","name":"' || s_name || '"}' AS payload, 3 AS priority, 9 AS section FROM supplier
  UNION ALL SELECT 'project:' || n_nationkey, 'project', 'projects/index.json', '{"id":"project:' || n_nationkey || '","source_refs":["src:' || (n_nationkey + 1) || '","src:' || (n_nationkey * 9) || '"]}', 1, 4 FROM nation
  UNION ALL SELECT 'event:chronology/current.jsonl:' || lpad(r_regionkey::VARCHAR, 6, '0'), 'event', 'chronology/current.jsonl', '{"name":"' || r_name || '"}', 2, 8 FROM region
  UNION ALL SELECT 'wrapper:projects/index.json', 'wrapper', 'projects/index.json', '{"completeness":"selective"}', 1, 0
)"""


@QUERIES.add("capsule_items", f"WITH {_ITEMS} SELECT item_id, kind, source_path, payload, priority FROM i")
def capsule_items(t):
    items = _items(t)
    capsule.require_items(items)
    return items


@QUERIES.add("item_order", f"WITH {_ITEMS} SELECT item_id, row_number() OVER (ORDER BY priority, section, source_path, item_id) - 1 AS vector_index FROM i")
def item_order(t):
    keyed = _items(t).withColumn("section", capsule.section_rank(F.col("kind")))
    return relations.indexed(keyed, ["priority", "section", "source_path", "item_id"]).select("item_id", "vector_index")


@QUERIES.add("item_identities", "SELECT 'capsule.identity' AS code, 'x' AS path FROM nation WHERE n_nationkey % 8 = 0 UNION ALL SELECT 'capsule.duplicate', 'item:' || r FROM (SELECT n_regionkey AS r FROM nation WHERE n_nationkey % 8 <> 0 GROUP BY 1 HAVING count(*) > 1)")
def item_identities(t):
    items = t("nation").select(F.when(F.col("n_nationkey") % 8 != 0, _text("item:", F.col("n_regionkey"))).alias("item_id"), F.lit("x").alias("source_path"))
    return capsule.item_findings(items).select("code", "path")


_PROFILES = "p AS (SELECT * FROM (VALUES ('SMALL', 1), ('WIDE', 3)) AS v(profile, most))"


def _selected(t) -> DataFrame:
    profiles = t("region").sparkSession.createDataFrame([("SMALL", 1), ("WIDE", 3)], "profile string, most int")
    return _items(t).join(F.broadcast(profiles), F.col("priority") <= F.col("most")).drop("most")


@QUERIES.add("kind_counts", f"WITH {_ITEMS}, {_PROFILES} SELECT profile, kind, count(*) AS n FROM i JOIN p ON priority <= most GROUP BY 1, 2")
def kind_counts(t):
    return capsule.kind_counts(_selected(t), ["profile"])


def _guards(t) -> DataFrame:
    return _items(t).where("kind = 'project'").select("item_id", F.posexplode(F.array(F.lit("A != B"), F.lit("C != D"))).alias("ordinal", "guard"))


_CAPSULE = f"""{_ITEMS}, {_PROFILES}, l AS (
  SELECT profile, priority, section, source_path, item_id, -1 AS nth, 'ITEM' || chr(9) || kind || chr(9) || source_path || chr(9) || payload AS line FROM i JOIN p ON priority <= most
  UNION ALL SELECT profile, priority, section, source_path, item_id, nth, 'BOUNDARY' || chr(9) || item_id || chr(9) || guard FROM i JOIN p ON priority <= most, (VALUES (0, 'A != B'), (1, 'C != D')) AS g(nth, guard) WHERE kind = 'project'
), c AS (SELECT profile, 'HEAD' || chr(10) || '[ITEMS]' || chr(10) || string_agg(line, chr(10) ORDER BY priority, section, source_path, item_id, nth) || chr(10) || '[END]' || chr(10) AS text FROM l GROUP BY profile)"""


def _capsules(t) -> DataFrame:
    return capsule.render_capsule(_selected(t), _guards(t), ["HEAD", "[ITEMS]"], ["[END]", ""])


@QUERIES.add(
    "capsule_text",
    f"""WITH {_CAPSULE} SELECT profile, list_sum(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'), lambda x: CASE WHEN regexp_matches(x, '^[\\p{{L}}\\p{{N}}_]') THEN ceil(strlen(x) / 4.0)::BIGINT ELSE 1 END))::BIGINT AS portable_tokens,
strlen(text)::BIGINT AS bytes, sha256(text) AS sha256, (SELECT count(*) FROM i JOIN p ON priority <= most WHERE p.profile = c.profile) AS included_items,
(SELECT count(*) FROM i) - (SELECT count(*) FROM i JOIN p ON priority <= most WHERE p.profile = c.profile) AS omitted_items, c.profile = 'SMALL' AS truncated FROM c""",
)
def capsule_text(t):
    return capsule.profile_entry(_capsules(t), _items(t), _selected(t), text.token_cost("text"))


@QUERIES.add(
    "capsule_findings",
    f"""WITH {_ITEMS}, {_PROFILES}, x AS (SELECT profile, i.*, profile || '/' || item_id AS path FROM i JOIN p ON priority <= most)
SELECT 'capsule.unknown_item' AS code, 'SMALL/term:odd' AS path UNION ALL SELECT 'capsule.fact_transform', path FROM x WHERE kind = 'event' AND source_path LIKE 'chron%' AND item_id LIKE '%3'
UNION ALL SELECT 'capsule.provenance_closure', path FROM x, (SELECT unnest([1, 2]) AS r) WHERE kind = 'project' AND profile = 'SMALL'
UNION ALL SELECT 'capsule.provenance_closure', path FROM x JOIN nation ON item_id = 'project:' || n_nationkey, (SELECT unnest([0, 1]) AS r) WHERE profile = 'WIDE' AND CASE r WHEN 0 THEN n_nationkey + 1 ELSE n_nationkey * 9 END NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'capsule.relationship_closure', 'SMALL/rel:1' UNION ALL SELECT 'capsule.unknown_item', 'SMALL/rel:1'
UNION ALL SELECT 'capsule.boundaries', path FROM x WHERE kind = 'project' AND item_id LIKE '%7' UNION ALL SELECT 'capsule.boundaries', 'WIDE/src:1'""",
)
def capsule_findings(t):
    spark = t("region").sparkSession
    refs = F.expr("try_variant_get(parse_json(payload), '$.source_refs', 'array<string>')")
    changed = F.when((F.col("kind") == "event") & F.col("item_id").endswith("3"), "{}").otherwise(F.col("payload"))
    null = F.lit(None).cast("string")
    parsed = _selected(t).select("profile", "item_id", "kind", "source_path", changed.alias("payload"), F.coalesce(refs, F.array().cast("array<string>")).alias("source_refs"), null.alias("source"), null.alias("target"))
    odd = spark.createDataFrame([("SMALL", "term:odd", "term", "x", "{}", [], None, None), ("SMALL", "rel:1", "relationship", "x", "{}", [], "project:1", "project:none")], parsed.schema)
    guards = _guards(t).select("item_id", "guard")
    said = _selected(t).join(guards, "item_id").select("profile", "item_id", "guard").where("not (item_id like '%7' and guard = 'A != B')")
    said = said.unionByName(spark.createDataFrame([("WIDE", "src:1", "A != B")], "profile string, item_id string, guard string"))
    return capsule.capsule_findings(parsed.unionByName(odd), said, _items(t), guards).select("code", "path")


@QUERIES.add(
    "retrieval_rows",
    f"""WITH {_ITEMS} SELECT 'chunk:' || item_id AS chunk_id, item_id AS canonical_id, kind AS record_type, source_path, sha256(payload || chr(10)) AS content_sha256, item_id || chr(10) || kind || chr(10) || source_path || chr(10) ||
  CASE kind WHEN 'source' THEN 'id' || chr(10) || item_id || chr(10) || 'name' || chr(10) || (payload->>'$.name') WHEN 'project' THEN 'id' || chr(10) || item_id || chr(10) || 'source_refs' || chr(10) || (payload->>'$.source_refs[0]') || chr(10) || (payload->>'$.source_refs[1]')
    WHEN 'event' THEN 'name' || chr(10) || (payload->>'$.name') ELSE 'completeness' || chr(10) || 'selective' END AS search_text,
  CASE WHEN kind = 'project' THEN array_to_string(list_sort([payload->>'$.source_refs[0]', payload->>'$.source_refs[1]']), ' ') ELSE '' END AS refs FROM i""",
)
def retrieval_rows(t):
    items = _items(t).withColumn("vector_index", F.lit(0))
    searched = text.search_text(F.col("item_id"), F.col("kind"), F.col("source_path"), F.col("payload"))
    rows = capsule.retrieval_rows(items, searched)
    return rows.select("chunk_id", "canonical_id", "record_type", "source_path", "content_sha256", "search_text", F.array_join("source_refs", " ").alias("refs"))


@QUERIES.add("payload_strings", f"WITH {_ITEMS} SELECT item_id, CASE kind WHEN 'source' THEN item_id || '|' || (payload->>'$.name') WHEN 'project' THEN item_id || '|' || (payload->>'$.source_refs[0]') || '|' || (payload->>'$.source_refs[1]') WHEN 'event' THEN payload->>'$.name' ELSE 'selective' END AS strings FROM i")
def payload_strings(t):
    return _items(t).select("item_id", F.array_join(text.payload_strings("payload"), "|").alias("strings"))


@QUERIES.add("base_order", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3")
def base_order(t):
    return capsule.in_base_order(t("nation").select("n_nationkey", "n_name", "n_regionkey"), t("region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "n_nationkey").select("n_nationkey", "n_name")


@QUERIES.add("priority_order", "SELECT doc_id, CASE WHEN lang = 'en' THEN 0 WHEN lang IN ('de', 'fr') THEN 1 WHEN lang = 'es' THEN 2 ELSE 3 END AS priority, row_number() OVER (ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN lang IN ('de', 'fr') THEN 1 WHEN lang = 'es' THEN 2 ELSE 3 END, source, doc_id) - 1 AS vector_index FROM documents")
def priority_order(t):
    kind = F.when(F.col("lang") == "en", "term").when(F.col("lang") == "de", "project").when(F.col("lang") == "fr", "wrapper").when(F.col("lang") == "es", "event").otherwise("source")
    path = F.when(F.col("lang") == "fr", "projects/index.json").otherwise("x")
    rows = t("documents").select("doc_id", files.priority(kind, path).alias("priority"), "source")
    return relations.indexed(rows, ["priority", "source", "doc_id"]).select("doc_id", "priority", "vector_index")


def _files(t) -> DataFrame:
    return t("nation").select(_text("n/", F.col("n_name")).alias("path"), _text(F.col("n_name"), "\n").alias("content"))


@QUERIES.add("checksums", "SELECT sha256(n_name || chr(10)) || '  n/' || n_name AS line FROM nation")
def checksums(t):
    return bundle.checksum_lines(_files(t))


@QUERIES.add("checksum_findings", "SELECT 'release.checksums' AS code, 'n/' || n_name AS path FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 'release.checksums', 'n/' || n_name FROM nation WHERE n_nationkey % 6 = 0 AND n_nationkey > 0")
def checksum_findings(t):
    k = F.col("n_nationkey")
    said = t("nation").where("n_nationkey > 0").select(F.concat(F.sha2(F.when(k % 6 == 0, "x").otherwise(_text(F.col("n_name"), "\n")), 256), F.lit("  n/"), "n_name").alias("line"))
    return bundle.checksum_findings(said, _files(t)).select("code", "path")


@QUERIES.add("bundle_findings", "SELECT 'bundle.path' AS code, '../' || n_name AS path FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT 'bundle.files', CASE WHEN n_nationkey % 7 = 0 THEN '../' ELSE 'f/' END || n_name FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 9 = 0 UNION ALL SELECT 'bundle.rebuild', CASE WHEN n_nationkey % 7 = 0 THEN '../' ELSE 'f/' END || n_name FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 9 = 0 OR n_nationkey % 4 = 0")
def bundle_findings(t):
    k = F.col("n_nationkey")
    path = _text(F.when(k % 7 == 0, "../").otherwise("f/"), F.col("n_name"))
    declared = t("nation").select(path.alias("path"), F.lit("a").alias("sha256"))
    actual = t("nation").where("n_nationkey % 5 <> 0").select(path.alias("path"), F.when(k % 9 == 0, "b").otherwise("a").alias("sha256"))
    rebuilt = t("nation").select(path.alias("path"), F.when(k % 4 == 0, "c").otherwise("a").alias("sha256"))
    return bundle.bundle_findings(declared, actual, rebuilt).select("code", "path")


@QUERIES.add("path_overlap", "SELECT a.n_nationkey AS a, b.r_regionkey AS b, a.n_nationkey % 4 < 3 AS overlap FROM nation a JOIN region b ON n_regionkey = r_regionkey")
def path_overlap(t):
    k = F.col("n_nationkey")
    own = F.when(k % 4 == 0, _text("/d/", F.col("r_regionkey"))).when(k % 4 == 1, _text("/d/", F.col("r_regionkey"), "/x")).when(k % 4 == 2, "/d").otherwise(_text("/d/", F.col("r_regionkey"), "x"))
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(k.alias("a"), F.col("r_regionkey").alias("b"), bundle.paths_overlap(own, _text("/d/", F.col("r_regionkey"))).alias("overlap"))


@QUERIES.add("snapshot_identity", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'snapshot-2026-01-01@git:' || substr(sha256(c_name), 1, 40) || '@sha256:' || sha256(c_name) END AS identity FROM customer")
def snapshot_identity(t):
    k, digest = F.col("c_custkey"), F.sha2("c_name", 256)
    commit = F.when(k % 5 == 0, F.upper(F.substr(F.concat(F.lit("A"), digest), F.lit(1), F.lit(40)))).otherwise(F.substr(digest, F.lit(1), F.lit(40)))
    return t("customer").select("c_custkey", bundle.snapshot_identity(F.lit("2026-01-01"), commit, F.when(k % 7 == 0, "x").otherwise(digest)).alias("identity"))


@QUERIES.add("release_fingerprint", """SELECT c_custkey, sha256('{"a":' || c_nationkey || ',"version":"1.' || c_custkey || '"}' || chr(10)) AS sha256 FROM customer""")
def release_fingerprint(t):
    packed = F.to_json(F.struct(_text("1.", F.col("c_custkey")).alias("version"), F.lit("own").alias("release_sha256"), F.col("c_nationkey").alias("a")))
    return t("customer").select("c_custkey", packed.alias("p")).select("c_custkey", bundle.release_fingerprint("p").alias("sha256"))


@QUERIES.add("reproducibility_paths", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS source FROM part")
def reproducibility_paths(t):
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, _text("docs/", k)).when(k % 5 == 1, _text("./docs\\", k)).when(k % 5 == 2, _text("dist/docs/", k)).when(k % 5 == 3, "README").otherwise("x/README")
    return t("part").select("p_partkey", bundle.reproducibility_source(path, ["docs"], ["README"]).alias("source"))


@QUERIES.add("status_lines", "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'M  a/' || s_suppkey ELSE '?? b/' || s_suppkey || '.py' END AS line FROM supplier WHERE s_suppkey % 4 IN (0, 1)")
def status_lines(t):
    k = F.col("s_suppkey")
    line = F.when(k % 4 == 0, _text("M  a/", k)).when(k % 4 == 1, _text(" ?? b/", k, ".py ")).when(k % 4 == 2, _text("?? a/__pycache__/", k)).otherwise(F.when(k % 8 == 3, _text("?? ", k, ".pyc")).otherwise("  "))
    return bundle.meaningful_status(t("supplier").select(line.alias("line")))


@QUERIES.add("identity_header", "SELECT s_suppkey, 'BLOCK/1' || chr(10) || 'NAME=' || s_name || chr(10) || 'KEY=' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey::VARCHAR END || chr(10) || 'FIXED=yes' || chr(10) AS header FROM supplier")
def identity_header(t):
    key = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string"))
    return t("supplier").select("s_suppkey", bundle.identity_header("BLOCK/1", {"NAME": F.col("s_name"), "KEY": key}, ("FIXED=yes",)).alias("header"))


_BODY = """b AS (
  SELECT 'TITLE' || chr(10) || '[A]' || chr(10) || (SELECT string_agg('FILE=' || r_name || chr(10) || 'x' || r_regionkey || chr(10) || 'END_FILE=' || r_name || chr(10), chr(10) ORDER BY r_regionkey) FROM region) || chr(10) || '[B]' || chr(10)
    || rtrim((SELECT string_agg('FILE=' || n_name || chr(10) || 'y' || n_nationkey || chr(10) || 'END_FILE=' || n_name || chr(10), chr(10) ORDER BY n_nationkey) FROM nation), chr(10)) || chr(10) AS body
)"""


def _body(t) -> DataFrame:
    section = lambda table, group, heading, key, name, mark: t(table).select(F.lit(group).alias("group"), F.lit(heading).alias("heading"), F.col(key).alias("ordinal"), F.col(name).alias("path"), _text(mark, F.col(key), "\n").alias("content"))
    return bundle.projection_body(section("region", 0, "[A]", "r_regionkey", "r_name", "x").unionByName(section("nation", 1, "[B]", "n_nationkey", "n_name", "y")), ["TITLE"])


@QUERIES.add("projection_body", f"WITH {_BODY} SELECT sha256(body) AS sha256, length(body)::BIGINT AS chars FROM b")
def projection_body(t):
    return _body(t).select(F.sha2("body", 256).alias("sha256"), F.char_length("body").cast("long").alias("chars"))


def _transports(t) -> DataFrame:
    body = _body(t).first()["body"]
    definitions = t("nation").select(_text("adapter:", F.col("n_regionkey")).alias("adapter_id"), _text("t/", F.col("n_name")).alias("path"), F.lit("knowledge").alias("role"), F.when(F.col("n_nationkey") % 2 == 0, _text("Read ", F.col("n_name"), " ")).alias("preamble"))
    return bundle.transports(body, definitions, bundle.identity_header("HEAD", {"ID": F.col("adapter_id")}), "BEGIN", "END\n".strip())


_TRANSPORTS = f"""{_BODY}, f AS (SELECT 'adapter:' || n_regionkey AS adapter_id, 't/' || n_name AS path, 'HEAD' || chr(10) || 'ID=adapter:' || n_regionkey || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'Read ' || n_name ELSE '' END || chr(10) || chr(10) || 'BEGIN' || chr(10) || body || 'END' || chr(10) AS content FROM nation, b)"""


@QUERIES.add("transports", f"WITH {_TRANSPORTS} SELECT adapter_id, path, sha256(content) AS sha256 FROM f")
def transports(t):
    return _transports(t).select("adapter_id", "path", F.sha2("content", 256).alias("sha256"))


@QUERIES.add("files_by_adapter", f"WITH {_TRANSPORTS} SELECT adapter_id, count(*) AS n, string_agg(path || ' ' || strlen(content), ',' ORDER BY path) AS files FROM f GROUP BY 1")
def files_by_adapter(t):
    rows = bundle.files_by_adapter(_transports(t))
    return rows.select("adapter_id", F.size("files").cast("long").alias("n"), F.array_join(F.transform("files", lambda x: F.concat_ws(" ", x["path"], x["bytes"].cast("string"))), ",").alias("files"))


@QUERIES.add("projection_findings", "SELECT 'adapter.projection' AS code, 't/' || n_name AS path FROM nation WHERE n_nationkey % 6 = 0")
def projection_findings(t):
    body = _body(t).first()["body"]
    broken = _transports(t).join(t("nation").select(_text("t/", F.col("n_name")).alias("path"), "n_nationkey"), "path")
    broken = broken.withColumn("content", F.when(F.col("n_nationkey") % 12 == 0, F.replace("content", F.lit("FILE="), F.lit("file="))).when(F.col("n_nationkey") % 6 == 0, "nothing").otherwise(F.col("content")))
    return bundle.projection_findings(broken, body, "BEGIN", "END").select("code", "path")


@QUERIES.add("policy_embedding", "SELECT 'delivery.embedding' AS code, doc_id::VARCHAR AS path FROM documents WHERE NOT contains(text, 'ea')")
def policy_embedding(t):
    return policy.embedding_findings(t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), "ea").select("code", "path")


@QUERIES.add("archive_metadata", """SELECT 'v' || s_suppkey AS version, '{"content_sha256":"d","doi":null,"license":"L","source_commit":"c","status":"unassigned","title":"T","version":"v' || s_suppkey || '"}' AS metadata FROM supplier""")
def archive_metadata(t):
    rows = t("supplier").select(_text("v", F.col("s_suppkey")).alias("version"), F.lit("unassigned").alias("status"), F.lit(None).cast("string").alias("doi"), F.lit("c").alias("source_commit"), F.lit("d").alias("content_sha256"))
    return bundle.archive_metadata(rows, {"title": "T", "license": "L"})


@QUERIES.add(
    "text_checks",
    r"""WITH p AS (SELECT page_id AS k, ['a/b', '/a', 'a/../b', 'a\b', '', 'C:/x', '.', 'a..b'][page_id % 8 + 1] AS path, ['2026-01-02T03:04:05Z', '2026-01-02T03:04:05+01:00', '2026-01-02T03:04:05', '2026-01-02 03:04Z', 'x'][page_id % 5 + 1] AS stamp FROM pages)
SELECT k AS page_id, k % 8 IN (0, 7) AS safe, [1767323045, 1767319445, NULL, 1767323040, NULL][k % 5 + 1]::BIGINT AS instant, CASE WHEN k % 3 = 0 THEN 'v1.' || k ELSE 'v' || k END AS tag,
  k % 4 = 0 AS commit, k % 4 = 1 AS digest, CASE WHEN k % 6 < 4 THEN 'in' || k END AS marked, 'a b' || k AS answer FROM p""",
)
def text_checks(t):
    k = F.col("page_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    path = pick(["a/b", "/a", "a/../b", "a\\b", "", "C:/x", ".", "a..b"], 8)
    stamp = pick(["2026-01-02T03:04:05Z", "2026-01-02T03:04:05+01:00", "2026-01-02T03:04:05", "2026-01-02 03:04Z", "x"], 5)
    digest = F.sha2(k.cast("string"), 256)
    some = F.when(k % 4 == 0, F.substr(digest, F.lit(1), F.lit(40))).when(k % 4 == 1, digest).when(k % 4 == 2, F.upper(F.concat(F.lit("a"), digest))).otherwise("")
    marked = F.when(k % 6 < 4, _text("x <<in", k, ">> y")).when(k % 6 == 4, "x <<in").otherwise("in>> <<")
    version = F.when(k % 3 == 0, _text("1.", k)).otherwise(_text("v", k))
    return t("pages").select(
        "page_id", text.safe_path(path).alias("safe"), F.unix_timestamp(text.zoned_timestamp(stamp)).alias("instant"), text.expected_tag(version).alias("tag"), text.is_commit(some).alias("commit"), text.is_digest(some).alias("digest"),
        text.between_markers(marked, "<<", ">>").alias("marked"), text.collapse(_text("  A\t b", k, " ")).alias("answer"),
    )


@QUERIES.add(
    "release_identity",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'o/r' || s_suppkey END AS repository, ['', 'no tag', 'commit is not valid', 'not from the release host', 'the page is another tag''s', 'the snapshot pins something else'][s_suppkey % 6 + 1] AS reason FROM supplier""",
)
def release_identity(t):
    k = F.col("s_suppkey")
    commit = F.when(k % 6 == 2, "x").otherwise(F.lpad(k.cast("string"), 40, "a"))
    host = F.when(k % 6 == 3, "example.com").otherwise("github.com")
    page = _text("https://", host, "/o/r", k, "/releases/tag/", F.when(k % 6 == 4, "v9").otherwise("v1%2F0"))
    x = text.release_identity(page, _text("https://", host, "/o/r", k, "/tree/", F.when(k % 6 == 5, "main").otherwise(commit)), F.when(k % 6 == 1, "").otherwise("v1/0"), commit)
    return t("supplier").select("s_suppkey", x["repository"].alias("repository"), F.coalesce(x["reason"], F.lit("")).alias("reason"))


@QUERIES.add("json_collections", """SELECT s_nationkey AS wrapper, s_nationkey || '/' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS place, s_name AS name FROM supplier""")
def json_collections(t):
    packed = t("supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("records"))
    exploded = packed.select("s_nationkey", F.explode(F.array("records")).alias("records"))
    parts = files.explode_collections(exploded.withColumn("key", F.col("s_nationkey")), ["records"])
    keyed = exploded.select("s_nationkey", F.posexplode("records").alias("ordinal", "record"))
    return keyed.join(parts.select("record").distinct(), "record", "left_semi").select(F.col("s_nationkey").alias("wrapper"), _text(F.col("s_nationkey"), "/", F.col("ordinal")).alias("place"), F.col("record.s_name").alias("name"))


@QUERIES.add("upsert_places", "SELECT s_suppkey AS k, s_suppkey - 1 AS ordinal, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE s_name END AS name FROM supplier UNION ALL SELECT 1000000 + n_nationkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_nationkey) - 1, 'added' FROM nation")
def upsert_places(t):
    base = t("supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") - 1).alias("ordinal"), F.col("s_name").alias("name"))
    update = t("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.lit("new").alias("name")).unionByName(t("nation").select((F.col("n_nationkey") + 1_000_000).alias("k"), F.lit("added").alias("name")))
    return relations.upsert(base, update, "k", ordinal="ordinal")


@QUERIES.add("registry_guards", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'REGISTRY_OMISSION != NEGATIVE_FACT' WHEN lang = 'fr' AND n_chars % 2 = 0 THEN 'UNASSERTED_LEGAL_OR_CORPORATE_STATUS != FALSE' ELSE '' END AS guards FROM documents")
def registry_guards(t):
    none = F.lit(None).cast("string")
    kind = F.when(F.col("lang") == "en", "wrapper").when(F.col("lang") == "fr", "organization").otherwise("claim")
    status = F.when(F.col("n_chars") % 2 == 0, "not_asserted_by_substrate").otherwise(none)
    found = files.boundary_guards(kind, F.lit("projects/index.json"), F.array().cast("array<string>"), F.lit("Selective list"), status)
    return t("documents").select("doc_id", F.array_join(found, "|").alias("guards"))


@QUERIES.add("canonical_payload", """SELECT event_id, '{"a":[true,null,' || event_id || '],"é":"' || event_type || '"}' AS payload FROM events""")
def canonical_payload(t):
    raw = F.concat(F.lit('{ "é" : "'), "event_type", F.lit('",\n "a": [true , null, '), F.col("event_id").cast("string"), F.lit("] }"))
    return t("events").select("event_id", raw.alias("raw")).select("event_id", canonical_json("raw").alias("payload"))
