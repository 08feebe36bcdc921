"""Integrity rules over registries that are made of the test tables, with faults by the remainders of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.operators import integrity
from recordlens.operators.export import DenyPolicy
from recordlens.plans.catalogue import Catalogue

QUERIES = Catalogue()

CLASSES, TYPES = ["repository", "release_record", "account"], ["publishes", "studies"]
DENY = DenyPolicy({"cloud-key": "KEY[0-9]{2,}5"}, {"local-url": "https?://localhost"}, ("comment",), (".env",))


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _records(rows: DataFrame, path: str, collection: str, ordinal: Column, kind: str, **fields: Column) -> DataFrame:
    own = {"record_type": F.lit(kind), "visibility": F.lit("public")} | fields
    return rows.select(F.lit(path).alias("path"), F.lit(collection).alias("collection"), ordinal.cast("int").alias("ordinal"), F.to_json(F.struct(*(c.alias(n) for n, c in own.items()))).alias("payload"))


def _refs(*refs: Column) -> Column:
    return F.array(*refs)


def _sources(t) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when((k % 4 == 0) | ((k % 4 == 1) & (k % 7 == 0)), "git_commit").when(k % 4 == 2, "api_identity").otherwise("release_tag_commit")
    commit = F.when(k % 9 == 0, "short").otherwise(F.lpad(k.cast("string"), 40, "a"))
    repo = _text("https://github.com/o/r", k % 5)
    snapshot = F.struct(
        kind.alias("kind"), commit.alias("commit"), F.when(k % 19 == 0, _text(repo, "/tree/main")).otherwise(_text(repo, "/tree/", commit)).alias("url"),
        F.when(k % 23 == 0, "").otherwise(_text("v", k % 3, ".0")).alias("tag"), F.when(k % 29 == 0, "x").otherwise(k.cast("string")).alias("release_id"),
        k.alias("github_id"), F.when(k % 6 == 0, F.lit(None)).otherwise(_text("u", k)).alias("login"),
    )
    names = F.element_at(F.array(*map(F.lit, ["repository", "release_record", "account", "odd"])), (k % 4 + 1).cast("int"))
    return _records(
        t("supplier"), "sources/index.json", "sources", k - 1, "source", id=_text(F.when(k % 17 == 0, "source:").otherwise("src:"), k), visibility=F.when(k % 13 == 0, "private").otherwise("public"),
        **{"class": names}, url=_text(repo, "/releases/tag/v", k % 3, ".0"), snapshot=F.when(k % 11 != 0, snapshot),
    )


_S = """
s AS (
  SELECT *, 'https://github.com/o/r' || (k % 5) AS repo, CASE WHEN k % 9 = 0 THEN 'short' ELSE lpad(k::VARCHAR, 40, 'a') END AS commit,
    CASE WHEN k % 4 = 0 OR (k % 4 = 1 AND k % 7 = 0) THEN 'git_commit' WHEN k % 4 = 2 THEN 'api_identity' ELSE 'release_tag_commit' END AS kind,
    ['repository', 'release_record', 'account', 'odd'][k % 4 + 1] AS class, k % 11 <> 0 AS snap, 'sources/index.json/sources#' || (k - 1) AS path
  FROM (SELECT s_suppkey AS k FROM supplier)
)"""


def _registry(parts: list[DataFrame], wrappers: DataFrame | None = None, **more) -> integrity.Registry:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    none = rows.sparkSession.createDataFrame([], "path string, type string, schema_version string, snapshot_date string, visibility string")
    return integrity.from_records(rows, none if wrappers is None else wrappers, **({"provenance_classes": CLASSES, "relationship_types": TYPES} | more))


def _found(parts: list[DataFrame]) -> DataFrame:
    return integrity.all_findings(parts).select("code", "path")


def _union(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS code, path FROM {source} WHERE {bad}" for code, bad in rules.items())


@QUERIES.add(
    "integrity_sources",
    f"""WITH {_S}, x AS (SELECT *, kind = 'release_tag_commit' AS rel, class = 'release_record' AS rec, kind IN ('git_commit', 'release_tag_commit') AS pins FROM s)
"""
    + _union(
        {
            "provenance.snapshot": "NOT snap",
            "provenance.commit": "snap AND pins AND commit = 'short'",
            "provenance.snapshot_url": "snap AND pins AND k % 19 = 0",
            "release.source_class": "snap AND rel AND NOT rec",
            "release.tag": "snap AND rel AND k % 23 = 0",
            "release.id": "snap AND rel AND k % 29 = 0",
            "release.snapshot": "snap AND rec AND NOT rel",
            "provenance.api_identity": "snap AND kind = 'api_identity' AND NOT rec AND k % 6 = 0",
            "release.origin": "snap AND rec AND (NOT rel OR k % 23 = 0 OR commit = 'short' OR k % 19 = 0)",
            "provenance.class": "class = 'odd'",
        },
        "x",
    ),
)
def integrity_sources(t):
    return _found(integrity.source_rules(_registry([_sources(t)])))


def _terms(t) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 31 == 0, " ").otherwise(_text("Term ", k % 400))
    aliases = F.array(_text("  tErM   ", k % 350), F.when(k % 37 == 0, "\t").otherwise(_text("own ", k)))
    return _records(
        t("customer"), "terminology/index.json", "records", k, "term", id=F.when(k % 41 == 0, "").when(k % 43 == 0, _text("word:", k)).otherwise(_text("term:", F.when(k % 47 == 0, F.lit(1)).otherwise(k))), name=name, aliases=aliases,
    )


_T = """
t AS (
  SELECT k, 'terminology/index.json/records#' || k AS path, CASE WHEN k % 31 = 0 THEN ' ' ELSE 'Term ' || (k % 400) END AS name,
    ['  tErM   ' || (k % 350), CASE WHEN k % 37 = 0 THEN chr(9) ELSE 'own ' || k END] AS aliases,
    CASE WHEN k % 41 = 0 THEN '' WHEN k % 43 = 0 THEN 'word:' || k ELSE 'term:' || CASE WHEN k % 47 = 0 THEN 1 ELSE k END END AS id
  FROM (SELECT c_custkey AS k FROM customer)
)"""


@QUERIES.add(
    "integrity_identity",
    f"""WITH {_S}, {_T}, r AS (
  SELECT path, 'term' AS kind, 'records' AS collection, k AS ordinal, id FROM t
  UNION ALL SELECT path, 'source', 'sources', k - 1, CASE WHEN k % 17 = 0 THEN 'source:' ELSE 'src:' END || k FROM s
), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY split_part(path, '#', 1), ordinal) AS nth FROM r WHERE id <> '')
SELECT 'identity.missing' AS code, path FROM r WHERE id = ''
UNION ALL SELECT 'identity.duplicate', path FROM n WHERE nth > 1
UNION ALL SELECT 'identity.prefix', path FROM r WHERE id <> '' AND NOT starts_with(id, CASE kind WHEN 'term' THEN 'term:' ELSE 'src:' END)
UNION ALL SELECT 'identity.unresolved', 'identity/public.json'""",
)
def integrity_identity(t):
    return _found(integrity.identity_rules(_registry([_sources(t), _terms(t)])))


@QUERIES.add(
    "integrity_aliases",
    f"""WITH {_T}, w AS (SELECT k, id, path, unnest([name] || aliases) AS a FROM t),
n AS (SELECT *, lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS norm FROM w),
o AS (SELECT *, first_value(id) OVER (PARTITION BY norm ORDER BY k) AS owner FROM n WHERE norm <> '')
SELECT 'alias.empty' AS code, path FROM n WHERE norm = '' UNION ALL SELECT 'alias.collision', path FROM o WHERE owner <> id""",
)
def integrity_aliases(t):
    return _found(integrity.alias_rules(_registry([_terms(t)])))


def _claims(t) -> DataFrame:
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    refs = F.when(k % 15 == 0, F.lit(None).cast("array<string>")).when(k % 10 == 0, none).otherwise(F.array(_text("src:", k % 120), _text("src:", k % 90 + 1)))
    return _records(
        t("part"), "context/public.json", "claims", k, "claim", id=_text("claim:", k), source_refs=refs, summary=_text("KEY", k, " ", F.col("p_name")),
        note=F.struct(F.when(k % 8 == 0, "see http://localhost/x").otherwise("none").alias(" text"), F.array(_text("KEY", k)).alias("list")),
    )


@QUERIES.add(
    "integrity_references",
    f"""WITH {_S}, i AS (SELECT CASE WHEN k % 17 = 0 THEN 'source:' ELSE 'src:' END || k AS id FROM s),
c AS (SELECT k, 'context/public.json/claims#' || k AS path, CASE WHEN k % 10 <> 0 AND k % 15 <> 0 THEN ['src:' || (k % 120), 'src:' || (k % 90 + 1)] END AS refs FROM (SELECT p_partkey AS k FROM part)),
u AS (SELECT path, unnest(refs) AS ref FROM c)
SELECT 'provenance.missing' AS code, path FROM c WHERE refs IS NULL UNION ALL SELECT 'provenance.dangling', path FROM u WHERE ref NOT IN (SELECT id FROM i)
UNION ALL SELECT 'provenance.missing', 'terminology/index.json/records#' || c_custkey FROM customer""",
)
def integrity_references(t):
    return _found(integrity.reference_rules(_registry([_sources(t), _claims(t), _terms(t)])))


@QUERIES.add(
    "integrity_scan",
    """WITH c AS (SELECT p_partkey AS k, 'context/public.json/claims#' || p_partkey AS path FROM part)
SELECT 'boundary.secret' AS code, path || '/@3' AS path FROM c WHERE regexp_matches('KEY' || k, 'KEY[0-9]{2,}5')
UNION ALL SELECT 'boundary.secret', path || '/@1/@1/0' FROM c WHERE regexp_matches('KEY' || k, 'KEY[0-9]{2,}5')
UNION ALL SELECT 'boundary.private_reference', path || '/@1/@0' FROM c WHERE k % 8 = 0
UNION ALL SELECT 'boundary.forbidden_field', 'manifest/@0'""",
)
def integrity_scan(t):
    registry = _registry([_claims(t)], deny=DENY, documents={"manifest": {"a": 1, "Comment": "x"}})
    rows = registry.records.withColumn("payload", integrity.canonical_json("payload"))
    registry.records = rows.withColumn("payload", F.regexp_replace("payload", '"source_refs":\\[[^\\]]*\\],', ""))
    return _found(integrity.scan_rules(registry))


_SCHEMA = {
    "type": "object",
    "required": ["id", "source_refs"],
    "properties": {"id": {"type": "string", "pattern": "^claim:[0-9]{1,3}$"}, "source_refs": {"type": "array", "minItems": 1, "items": {"not": {"const": "src:7"}}}, "note": {"required": ["list"], "properties": {"list": {"maxItems": 1}}}},
}


@QUERIES.add(
    "integrity_schema",
    """WITH c AS (SELECT k, 'context/public.json/claims#' || k AS path FROM (SELECT p_partkey AS k FROM part))
SELECT 'schema.invalid' AS code, path || '/<field>' AS path FROM c WHERE k > 999
UNION ALL SELECT 'schema.invalid', path FROM c WHERE k % 15 = 0
UNION ALL SELECT 'schema.invalid', path || '/<field>' FROM c WHERE k % 10 = 0 AND k % 15 <> 0
UNION ALL SELECT 'schema.invalid', path || '/<field>/0' FROM c WHERE k % 10 <> 0 AND k % 15 <> 0 AND k % 120 = 7
UNION ALL SELECT 'schema.invalid', path || '/<field>/1' FROM c WHERE k % 10 <> 0 AND k % 15 <> 0 AND k % 90 = 6""",
)
def integrity_schema(t):
    return _found(integrity.schema_rules(_registry([_claims(t)], record_schema=_SCHEMA)))


def _projects(t) -> DataFrame:
    k = F.col("n_nationkey")
    return _records(t("nation"), "projects/index.json", "records", k, "project", id=_text("project:", k), repository=F.when(k % 12 == 0, F.lit(None)).otherwise(_text("o/r", k % 20)), source_refs=_refs(F.lit("src:1")))


def _publications(t) -> DataFrame:
    k = F.col("p_partkey")
    doi = F.when(k % 50 == 0, "10.1/x").when(k % 26 == 0, F.lit(None)).otherwise(_text(F.when(k % 2 == 0, "https://doi.org/").otherwise(""), "10.1234/P", k % 150))
    return _records(
        t("part"), "publications/index.json", "records", k, "publication", id=_text("publication:", k), doi=doi, repository=_text("o/r", k % 23), version=F.when(k % 4 == 0, F.lit(None)).otherwise(_text(k % 3, ".0")),
        commit=F.when(k % 5 == 0, F.lit(None)).otherwise(F.lpad((k % 100 + 1).cast("string"), 40, "a")), source_refs=F.array(_text("src:", k % 100 + 1), _text("src:", k % 60 + 1)),
    )


_P = """
j AS (SELECT n_nationkey AS k, 'project:' || n_nationkey AS id, 'projects/index.json/records#' || n_nationkey AS path, CASE WHEN n_nationkey % 12 <> 0 THEN 'o/r' || (n_nationkey % 20) END AS repo FROM nation),
p AS (
  SELECT k, 'publication:' || k AS id, 'publications/index.json/records#' || k AS path, 'o/r' || (k % 23) AS repo, CASE WHEN k % 4 <> 0 THEN (k % 3) || '.0' END AS version,
    CASE WHEN k % 5 <> 0 THEN lpad((k % 100 + 1)::VARCHAR, 40, 'a') END AS commit, ['src:' || (k % 100 + 1), 'src:' || (k % 60 + 1)] AS refs,
    CASE WHEN k % 50 = 0 THEN '10.1/x' WHEN k % 26 = 0 THEN NULL ELSE '10.1234/p' || (k % 150) END AS doi
  FROM (SELECT p_partkey AS k FROM part)
),
l AS (SELECT 'src:' || k AS id, CASE WHEN snap AND kind = 'release_tag_commit' AND k % 23 <> 0 AND commit <> 'short' AND k % 19 <> 0 THEN 'o/r' || (k % 5) END AS repo, 'v' || (k % 3) || '.0' AS tag, commit
  FROM s WHERE class = 'release_record' AND k % 17 <> 0 UNION ALL SELECT 'source:' || k, NULL, NULL, NULL FROM s WHERE false)"""


@QUERIES.add(
    "integrity_publications",
    f"""WITH {_S}, {_P}, d AS (SELECT *, doi IS NOT NULL AND doi <> '10.1/x' AS sound FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY k) AS nth FROM d WHERE sound),
c AS (SELECT p.path, p.repo, p.version, p.commit, l.repo AS lr, l.tag, l.commit AS lc FROM (SELECT *, unnest(refs) AS ref FROM p) p JOIN l ON ref = l.id),
m AS (
  SELECT path, bool_or(coalesce(lr = repo, false)) AS r, bool_or(coalesce(lr = repo, false) AND (version IS NULL OR coalesce(tag = 'v' || version, false))) AS v,
    bool_or(coalesce(lr = repo, false) AND (version IS NULL OR coalesce(tag = 'v' || version, false)) AND coalesce(lc = commit, false)) AS x, bool_or(commit IS NOT NULL) AS has FROM c GROUP BY path
)
SELECT 'project.repository' AS code, path FROM j WHERE repo IS NULL
UNION ALL SELECT 'project.repository_duplicate', path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k) AS nth FROM j WHERE repo IS NOT NULL) WHERE nth > 1
UNION ALL SELECT 'doi.invalid', path FROM d WHERE NOT sound UNION ALL SELECT 'doi.duplicate', path FROM n WHERE nth > 1
UNION ALL SELECT 'publication.project', path FROM p WHERE repo NOT IN (SELECT repo FROM j WHERE repo IS NOT NULL)
UNION ALL SELECT 'release.repository', path FROM m WHERE NOT r UNION ALL SELECT 'release.version', path FROM m WHERE r AND NOT v
UNION ALL SELECT 'release.commit', path FROM m WHERE r AND has AND NOT x""",
)
def integrity_publications(t):
    return _found(integrity.publication_rules(_registry([_sources(t), _projects(t), _publications(t)])))


def _edges(t) -> DataFrame:
    k, pub = F.col("k"), F.col("pub")
    # The publication travels beside the key: it can't be had back from a key where parts are numbered beyond a million.
    rows = t("part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("pub"))
    rows = rows.unionByName(t("part").where("p_partkey % 9 = 0").select((F.col("p_partkey") + 1_000_000).alias("k"), F.col("p_partkey").alias("pub")))
    source = F.when(pub % 33 == 0, _text("topic:", pub % 5)).when(pub % 21 == 0, "project:none").otherwise(_text("project:", pub % 25))
    verb = F.when(pub % 28 == 0, "likes").when(pub % 6 == 0, "studies").otherwise("publishes")
    return _records(rows, "relationships/graph.json", "edges", k, "relationship", id=_text("rel:", k), source=source, relationship=verb, target=F.when(pub % 35 == 0, "publication:none").otherwise(_text("publication:", pub)), source_refs=_refs(F.lit("src:1")))


def _topics(t) -> DataFrame:
    k = F.col("r_regionkey")
    return _records(t("region"), "relationships/graph.json", "nodes", k, "research_topic", id=_text("topic:", k + 2))


_G = """
e AS (
  SELECT k, 'relationships/graph.json/edges#' || k AS path, CASE WHEN b % 28 = 0 THEN 'likes' WHEN b % 6 = 0 THEN 'studies' ELSE 'publishes' END AS verb,
    CASE WHEN b % 33 = 0 THEN 'topic:' || (b % 5) WHEN b % 21 = 0 THEN 'project:none' ELSE 'project:' || (b % 25) END AS src, CASE WHEN b % 35 = 0 THEN 'publication:none' ELSE 'publication:' || b END AS dst
  FROM (SELECT p_partkey AS k, p_partkey AS b FROM part UNION ALL SELECT p_partkey + 1000000, p_partkey FROM part WHERE p_partkey % 9 = 0)
), o AS (SELECT 'topic:' || (r_regionkey + 2) AS id, 'relationships/graph.json/nodes#' || r_regionkey AS path FROM region),
ids AS (SELECT id FROM j UNION SELECT id FROM p UNION SELECT id FROM o)"""


@QUERIES.add(
    "integrity_graph",
    f"""WITH {_S}, {_P}, {_G}, b AS (
  SELECT p.path, p.repo, count(e.src) AS n, max(j.id) AS jid, max(j.repo) AS jr FROM p LEFT JOIN e ON e.verb = 'publishes' AND e.dst = p.id LEFT JOIN j ON j.id = e.src GROUP BY p.path, p.repo
)
SELECT 'relationship.source' AS code, path FROM e WHERE src NOT IN (SELECT id FROM ids) UNION ALL SELECT 'relationship.target', path FROM e WHERE dst NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'relationship.publishes_source', path FROM e WHERE verb = 'publishes' AND src NOT IN (SELECT id FROM j)
UNION ALL SELECT 'publication.relationship', path FROM b WHERE n <> 1 UNION ALL SELECT 'publication.relationship_source', path FROM b WHERE n = 1 AND jid IS NULL
UNION ALL SELECT 'publication.relationship_repository', path FROM b WHERE n = 1 AND jid IS NOT NULL AND jr IS DISTINCT FROM repo
UNION ALL SELECT 'provenance.topic', path FROM o WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)
UNION ALL SELECT 'relationship.type', path FROM e WHERE verb = 'likes'""",
)
def integrity_graph(t):
    return _found(integrity.graph_rules(_registry([_projects(t), _publications(t), _edges(t), _topics(t)])))


def _events(t) -> DataFrame:
    k = F.col("event_id")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + k * 60 - F.when(k % 45 == 0, 600).otherwise(0))
    text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(k % 38 == 0, text).when(k % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("+00:00")))
    meta = F.struct(F.when(k % 3 != 0, _text("v", k % 3, ".0")).alias("tag"), _text("o/r", k % 22).alias("repository"), F.when(k % 4 == 0, _text("doi:10.1234/P", k % 150)).alias("doi"))
    return _records(t("events"), "chronology/current.jsonl", "<root>", k, "event", id=_text("event:", k), occurred_at=stamp, metadata=F.when(k % 14 != 0, meta), source_refs=_refs(_text("src:", k % 100 + 1)))


@QUERIES.add(
    "integrity_chronology",
    f"""WITH {_S}, {_P}, v AS (
  SELECT k, 'chronology/current.jsonl/<root>#' || k AS path, CASE WHEN k % 38 <> 0 THEN 1700000000 + k * 60 - CASE WHEN k % 45 = 0 THEN 600 ELSE 0 END END AS tm,
    CASE WHEN k % 14 <> 0 AND k % 3 <> 0 THEN 'v' || (k % 3) || '.0' END AS tag, 'o/r' || (k % 22) AS repo, CASE WHEN k % 4 = 0 THEN '10.1234/p' || (k % 150) END AS doi, 'src:' || (k % 100 + 1) AS ref
  FROM (SELECT event_id AS k FROM events)
), o AS (SELECT *, last_value(tm IGNORE NULLS) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
g AS (SELECT v.*, l.id AS lid, coalesce(l.repo = v.repo AND l.tag = v.tag, false) AS hit FROM v LEFT JOIN l ON l.id = v.ref WHERE v.tm IS NOT NULL AND v.tag IS NOT NULL),
u AS (SELECT doi, repo, 'v' || version AS tag FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY k) AS nth FROM p WHERE doi IS NOT NULL AND doi <> '10.1/x') WHERE nth = 1)
SELECT 'chronology.timestamp' AS code, path FROM v WHERE tm IS NULL UNION ALL SELECT 'chronology.order', path FROM o WHERE tm < before
UNION ALL SELECT 'release.event_project', path FROM g WHERE repo NOT IN (SELECT repo FROM j WHERE repo IS NOT NULL)
UNION ALL SELECT 'release.event_source', path FROM g WHERE lid IS NULL UNION ALL SELECT 'release.event_identity', path FROM g WHERE lid IS NOT NULL AND NOT hit
UNION ALL SELECT 'release.event_doi', g.path FROM g LEFT JOIN u ON u.doi = g.doi WHERE g.doi IS NOT NULL AND NOT coalesce(u.repo = g.repo AND u.tag = g.tag, false)""",
)
def integrity_chronology(t):
    return _found(integrity.chronology_rules(_registry([_sources(t), _projects(t), _publications(t), _events(t)])))


@QUERIES.add(
    "integrity_wrappers",
    f"""WITH {_S}, w AS (SELECT 'file/' || n_nationkey AS path, n_nationkey AS k FROM nation)
SELECT 'payload.schema_version' AS code, path FROM w WHERE k % 5 = 0 UNION ALL SELECT 'boundary.visibility', path FROM w WHERE k % 7 = 0
UNION ALL SELECT 'snapshot.mismatch', path FROM w WHERE k % 3 = 0 UNION ALL SELECT 'boundary.visibility', path FROM s WHERE k % 13 = 0
UNION ALL SELECT 'payload.record_type', 'odd/index.json/records#' || r_regionkey FROM region""",
)
def integrity_wrappers(t):
    k = F.col("n_nationkey")
    wrappers = t("nation").select(
        _text("file/", k).alias("path"), F.lit("registry").alias("type"), F.when(k % 5 == 0, "0.9").otherwise("1.0.0").alias("schema_version"),
        F.when(k % 3 == 0, F.lit(None)).otherwise("2026-01-01").alias("snapshot_date"), F.when(k % 7 == 0, "private").otherwise("public").alias("visibility"),
    )
    odd = _records(t("region"), "odd/index.json", "records", F.col("r_regionkey"), "term", id=F.lit("term:x"))
    return _found(integrity.wrapper_rules(_registry([_sources(t), odd], wrappers, snapshot_date="2026-01-01")))


@QUERIES.add(
    "integrity_report",
    "SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS records, (SELECT count(*) FROM supplier) AS sources, 0::BIGINT AS edges, (SELECT count(*) FROM part) AS publications, 0::BIGINT AS events",
)
def integrity_report(t):
    return integrity.report(_registry([_sources(t), _publications(t)]))


_CONFIG = {
    "boundary": {"repository_visibility": "public", "publication_model": "open", "absence_semantics": "unavailable_not_false", "private_source_access_required": False, "export_contract": {"default_publication_grants": 0}},
    "policy": {"export_policy": "open", "immutable_payload_files": []},
    "include": None,
    "exclude": {"default": "deny_on_match", "forbidden_source_path_globs": ["x"], "forbidden_field_names": [], "secret_patterns": [{"id": "a", "regex": "("}], "private_reference_patterns": "x"},
}


@QUERIES.add(
    "integrity_config",
    """SELECT * FROM (VALUES ('boundary.config', 'include'), ('boundary.invariant', 'boundary/publication_model'), ('boundary.immutability', 'boundary/export_contract'), ('boundary.policy', 'policy'),
('boundary.immutability', 'policy'), ('boundary.allowlist', 'include'), ('boundary.config', 'secret_patterns[0]'), ('boundary.config', 'private_reference_patterns'),
('boundary.detector_disabled', 'exclude/forbidden_field_names'), ('boundary.detector_disabled', 'exclude/secret_patterns'), ('boundary.detector_disabled', 'exclude/private_reference_patterns')) AS v(code, path)""",
)
def integrity_config(t):
    return t("region").sparkSession.createDataFrame(integrity.config_findings(_CONFIG), "code string, path string, message string").select("code", "path")


@QUERIES.add(
    "integrity_contracts",
    """SELECT * FROM (VALUES ('schema.definition', 'bad'), ('schema.registration', 'ai/manifest.json/machine_contract_schemas'), ('schema.invalid', 'ai/manifest.json'), ('schema.missing', 'ai/manifest.json/schema'),
('schema.instance', 'public_export/policy.json'), ('schema.missing', 'export_schemas/allowlist'), ('schema.invalid', 'public_export/exclude.json/<field>'), ('schema.missing', 'ai/manifest.json/validation_schemas/report'),
('ontology.invalid', 'ai/ontology.json'), ('boundary.machine_file', 'm')) AS v(code, path)""",
)
def integrity_contracts(t):
    files = {
        "ai/manifest.json": {"machine_contract_schemas": {}, "schema": "bad", "export_schemas": {"policy": "s", "deny_policy": "s"}, "validation_schemas": {"fingerprint": "s"}, "normative_machine_files": ["m"]},
        "schema/manifest.schema.json": {"required": ["protocol"]}, "schema/public-boundary.schema.json": {}, "bad": {"type": "odd"}, "s": {"properties": {"default": {"const": "deny_on_match"}}},
        "ai/public-boundary.json": {}, "public_export/exclude.json": {"default": "x"}, "ai/ontology.json": [],
    }
    return t("region").sparkSession.createDataFrame(integrity.contract_findings(files), "code string, path string, message string").select("code", "path")


@QUERIES.add(
    "payload_set",
    """WITH f AS (SELECT n_nationkey, chr(39) || 'places/' || n_name || '.json' || chr(39) AS path FROM nation WHERE n_nationkey < 6)
SELECT r_regionkey AS case_id, 'payload files don' || chr(39) || 't agree; missing=[' || string_agg(path, ', ' ORDER BY path) || '], unknown=[]' AS problem
FROM region JOIN f ON (n_nationkey + r_regionkey) % 6 = 0 GROUP BY r_regionkey""",
)
def payload_set(t):
    """The files that each region declares against those that are expected."""
    files = t("nation").where("n_nationkey < 6").select("n_nationkey", F.concat(F.lit("places/"), "n_name", F.lit(".json")).alias("path"))
    expected = [r["path"] for r in files.collect()]
    declared = t("region").join(files, (F.col("n_nationkey") + F.col("r_regionkey")) % 6 > 0).groupBy("r_regionkey").agg(F.collect_list("path").alias("paths"))
    cases = [(r["r_regionkey"], integrity.file_set_problem(r["paths"], expected)) for r in declared.collect()]
    return files.sparkSession.createDataFrame(cases, "case_id int, problem string")
