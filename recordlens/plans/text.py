"""Queries over texts: embeddings, similarity, lexical search, token costs, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.functions import hashing, text
from recordlens.operators import budget, export, postings, retrieval, tiles
from recordlens.plans.catalogue import Catalogue

QUERIES = Catalogue()

ASKED = "the edition of ante and the tion that heer en le der que"
JOINED = r"[\p{L}\p{N}_]+(?:[-.:/][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"
PLAIN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"


def _sums(source: str) -> str:
    """SQL for bucket sums of the features of (id, text) rows."""
    return f"""
    SELECT id, ('0x' || h[1:2])::INT AS dim, sum(CASE WHEN h[10] IN ('1','3','5','7','9','b','d','f') THEN w ELSE -w END) AS val
    FROM (
      SELECT id, sha256(f) AS h, w FROM (
        SELECT id, 'u' || chr(0) || unnest(t) AS f, 1.0::DOUBLE AS w FROM ({source})
        UNION ALL
        SELECT id, 'b' || chr(0) || unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(0) || t[i + 1])) AS f, 0.5::DOUBLE AS w
        FROM ({source}) WHERE len(t) > 1
      )
    ) GROUP BY id, dim"""


def _half(x: str) -> str:
    """SQL for a number as it comes back from a 16-bit float: eleven bits of it, halves to even."""
    unit = f"pow(2, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / {unit}, 0) * {unit} END"


_DOC_TOKENS = f"SELECT doc_id AS id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{JOINED}') AS t FROM documents"
_ASKED_TOKENS = f"SELECT 0 AS id, regexp_extract_all(replace(lower('{ASKED}'), 'ß', 'ss'), '{JOINED}') AS t"


@QUERIES.add(
    "embed_topk",
    f"""
WITH d AS ({_sums(_DOC_TOKENS)}), q AS ({_sums(_ASKED_TOKENS)}),
dn AS (SELECT id, sqrt(sum(val * val)) AS n FROM d GROUP BY id), qn AS (SELECT sqrt(sum(val * val)) AS n FROM q),
h AS (SELECT d.id, dim, {_half('d.val / dn.n')} AS val FROM d JOIN dn ON d.id = dn.id WHERE dn.n > 0),
s AS (SELECT h.id, sum(h.val * q.val / qn.n) AS score FROM h JOIN q USING (dim), qn GROUP BY h.id)
SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN s ON doc_id = id
ORDER BY round(coalesce(score, 0), 12) DESC, doc_id LIMIT 5
""",
)
def embed_topk(t):
    return retrieval.text_topk(t("documents"), "doc_id", "text", ASKED, 5)


@QUERIES.add("embed_features", f"SELECT id AS doc_id, dim, val FROM ({_sums(_DOC_TOKENS)})")
def embed_features(t):
    return hashing.feature_sums(t("documents"), "doc_id", "text")


def _vectors(t):
    return t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


_PAIRS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE {which}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5
"""


@QUERIES.add("vector_topk", _PAIRS.format(which="a.vec_id = 0"))
def vector_topk(t):
    asked = _vectors(t).where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return tiles.vector_topk(asked, _vectors(t), 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@QUERIES.add("vector_topk_per_query", _PAIRS.format(which="a.vec_id % 50 = 0"))
def vector_topk_per_query(t):
    asked = _vectors(t).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return tiles.vector_topk(asked, _vectors(t), 5).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@QUERIES.add(
    "half_precision_norms",
    f"""WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), h AS (SELECT vec_id, {_half('x')} AS x FROM c)
SELECT vec_id, round(sum(x * x), 6) AS norm2 FROM h GROUP BY vec_id""",
)
def half_precision_norms(t):
    rounded = hashing.half_precision(F.col("embedding").cast("array<double>"))
    return t("embeddings").select("vec_id", F.round(hashing.dot(rounded, rounded), 6).alias("norm2"))


@QUERIES.add(
    "lexical_topk",
    r"""
WITH q AS (
  SELECT item_id AS query_id, text AS query, list_distinct(list_filter(regexp_extract_all(lower(text), '[A-Za-z0-9_.:/=-]+'), lambda x: length(x) > 2)) AS toks FROM benchmark
), r AS (
  SELECT doc_id AS record_id, lower(text) AS body, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9_.:/=-]+')) AS toks FROM documents
), qt AS (SELECT query_id, unnest(toks) AS tok FROM q), rt AS (SELECT record_id, unnest(toks) AS tok FROM r),
c AS (SELECT query_id, record_id, count(*) AS n FROM qt JOIN rt USING (tok) GROUP BY ALL),
s AS (
  SELECT q.query_id, r.record_id, 2 * coalesce(c.n, 0) + CASE WHEN contains(r.body, lower(q.query)) THEN 1 ELSE 0 END AS score
  FROM q CROSS JOIN r LEFT JOIN c ON c.query_id = q.query_id AND c.record_id = r.record_id
), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, record_id, score::BIGINT AS score FROM k WHERE rank <= 5
""",
)
def lexical_topk(t):
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return postings.lexical_topk(asked, t("documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("body")), 5)


_COST = (
    f"list_sum(list_transform(regexp_extract_all(text, '{PLAIN}'), lambda x: "
    r"CASE WHEN regexp_matches(x, '^[\p{L}\p{N}_]') THEN ceil(strlen(x) / 4.0)::BIGINT ELSE 1 END))::BIGINT"
)


@QUERIES.add("token_cost", f"SELECT doc_id, coalesce({_COST}, 0) AS tokens FROM documents")
def token_cost(t):
    return t("documents").select("doc_id", text.token_cost(F.col("text")).alias("tokens"))


@QUERIES.add(
    "token_cost_by_lang",
    f"""SELECT lang, count(*) AS docs, sum(tokens)::BIGINT AS tokens, round_even(sum(tokens) / count(*)::DOUBLE, 3) AS mean_tokens
FROM (SELECT lang, coalesce({_COST}, 0) AS tokens FROM documents) GROUP BY lang""",
)
def token_cost_by_lang(t):
    costs = t("documents").select("lang", text.token_cost(F.col("text")).alias("tokens"))
    n = F.count(F.lit(1))
    return costs.groupBy("lang").agg(n.alias("docs"), F.sum("tokens").alias("tokens"), F.bround(F.sum("tokens") / n, 3).alias("mean_tokens"))


@QUERIES.add(
    "budget_reduction",
    f"""
WITH c AS (SELECT doc_id, coalesce({_COST}, 0) AS tokens, doc_id IN (SELECT doc_id FROM labels) AS hit, text IS NOT NULL AS closed FROM documents)
SELECT count(*) AS queries, count_if(hit)::BIGINT AS hits, round_even(avg(hit::INT), 6) AS hit_rate, round_even(avg(tokens), 3) AS mean_tokens,
  round_even(1 - avg(tokens) / 8192, 6) AS reduction_micro, round_even(1 - avg(tokens) / 24576, 6) AS reduction_standard,
  round_even(1 - avg(tokens) / 131072, 6) AS reduction_full, bool_and(closed) AS all_closed FROM c
""",
)
def budget_reduction(t):
    labelled = t("labels").select(F.col("doc_id").alias("l")).distinct()
    docs = t("documents").join(labelled, F.col("doc_id") == F.col("l"), "left")
    return retrieval.retrieval_report(
        docs.select(F.col("l").isNotNull().alias("hit"), text.token_cost(F.col("text")).alias("tokens"), F.col("text").isNotNull().alias("closed"))
    )


@QUERIES.add(
    "greedy_pack",
    f"""
WITH RECURSIVE i AS (
  SELECT source, doc_id, coalesce({_COST}, 0) AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents
), f AS (
  SELECT source, doc_id, cost, rn, cost <= 8192 AS taken, CASE WHEN cost <= 8192 THEN cost ELSE 0 END AS used FROM i WHERE rn = 1
  UNION ALL
  SELECT i.source, i.doc_id, i.cost, i.rn, f.used + i.cost <= 8192, CASE WHEN f.used + i.cost <= 8192 THEN f.used + i.cost ELSE f.used END
  FROM f JOIN i ON i.source = f.source AND i.rn = f.rn + 1
)
SELECT source, doc_id, cost FROM f WHERE taken
""",
)
def greedy_pack(t):
    items = t("documents").select("source", "doc_id", "n_chars", text.token_cost(F.col("text")).alias("cost"))
    return budget.greedy_pack(items, "source", ["n_chars", "doc_id"], "cost", 8192).select("source", "doc_id", "cost")


@QUERIES.add("content_fingerprint", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents")
def content_fingerprint(t):
    return t("documents").select("doc_id", hashing.sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


#: Detectors for the test tables, in words that both engines' regular expressions read alike.
_SCANNED = {
    "cloud-key": r"AKIA[A-Z0-9]{12,}",
    "private-key": r"-----BEGIN [A-Z ]+-----",
    "hexadecimal": r"[0-9a-f]{32,}",
    "assignment": r"(?i)(?:password|secret|token|api_?key) ?[:=] ?\S{8,}",
}


@QUERIES.add(
    "secret_scan",
    " UNION ALL ".join(
        f"SELECT '{table}' AS origin, {key} AS id, '{name}' AS pattern_id FROM {table} WHERE regexp_matches({column}, '{p}')"
        for table, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "html"))
        for name, p in _SCANNED.items()
    ),
)
def secret_scan(t):
    docs = export.scan_text(t("documents"), "doc_id", ["text"], _SCANNED).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "pattern_id")
    pages = export.scan_text(t("pages"), "page_id", ["html"], _SCANNED).select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), "pattern_id")
    return docs.unionByName(pages)


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@QUERIES.add(
    "redacted_projection",
    f"""SELECT 'doc:' || doc_id AS id, 'claim' AS record_type, 'public' AS visibility, lang, '[REDACTED]' AS source,
regexp_replace(text, '{_MAIL}', '[REDACTED]', 'g') AS body, len(regexp_extract_all(text, '{_MAIL}'))::INT AS redactions FROM documents""",
)
def redacted_projection(t):
    rows = t("documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"),
        "lang",
        "source",
        F.regexp_replace("text", _MAIL, export.REDACTED).alias("body"),
        F.size(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0))).alias("redactions"),
    )
    rules = (export.FieldRule("lang", copy="lang"), export.FieldRule("source", redact="source"), export.FieldRule("body", copy="body"), export.FieldRule("redactions", copy="redactions"))
    records, _ = export.project(rows, export.Directive("d", "claim", "known", "key", rules))
    return records.select("id", "record_type", "visibility", "lang", "source", "body", "redactions")


@QUERIES.add(
    "url_identity",
    r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path FROM pages""",
)
def url_identity(t):
    return t("pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.url_path(F.col("url")).alias("path"))


@QUERIES.add(
    "visible_refs",
    r"""SELECT page_id, unnest(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS ref FROM pages""",
)
def visible_refs(t):
    return t("pages").select("page_id", F.explode(text.visible_refs(F.col("html"), 'href="([^"]*)"')).alias("ref"))


_LICENCES = ["All rights reserved.", "Released under the MIT License."]


@QUERIES.add(
    "ablation",
    """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(x, 'Licensed') OR x IN ('All rights reserved.', 'Released under the MIT License.'))), chr(10)) AS text,
len(string_split(text, chr(10)))::INT AS lines_before FROM documents""",
)
def ablation(t):
    return t("documents").select(
        "doc_id", text.drop_lines(F.col("text"), ["Licensed"], _LICENCES).alias("text"), F.size(F.split("text", "\n")).alias("lines_before")
    )


@QUERIES.add(
    "doi_normalise",
    r"""
WITH d AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://doi.org/' WHEN page_id % 3 = 1 THEN 'DOI:' ELSE '' END || '10.' || (1000 + page_id) || '/' || regexp_replace(url, '^[a-z]+://', '') AS doi FROM pages),
n AS (SELECT page_id, lower(regexp_replace(trim(doi), '(?i)^(https?://(dx\.)?doi\.org/|doi:)', '')) AS doi FROM d)
SELECT page_id, doi, regexp_matches(doi, '^10\.[0-9]{4,9}/\S+$') AS valid FROM n
""",
)
def doi_normalise(t):
    form = F.when(F.col("page_id") % 3 == 0, "https://doi.org/").when(F.col("page_id") % 3 == 1, "DOI:").otherwise("")
    doi = F.concat(form, F.lit("10."), (1000 + F.col("page_id")).cast("string"), F.lit("/"), F.regexp_replace("url", "^[a-z]+://", ""))
    return t("pages").select("page_id", doi.alias("d")).select("page_id", text.normal_doi(F.col("d")).alias("doi"), text.is_doi(F.col("d")).alias("valid"))


@QUERIES.add(
    "semver_parse",
    r"""
WITH v AS (SELECT p_partkey, p_size || '.' || (p_partkey % 7) || '.0' || CASE WHEN p_partkey % 5 = 0 THEN '-beta.0' || (p_partkey % 10) WHEN p_partkey % 5 = 1 THEN '-rc.' || (p_partkey % 4) ELSE '' END AS version FROM part),
p AS (SELECT *, regexp_extract(version, '^([0-9]+)\.([0-9]+)\.([0-9]+)(?:-([0-9A-Za-z.-]+))?$', 4) AS pre FROM v)
SELECT p_partkey, version, len(list_filter(string_split(pre, '.'), lambda x: regexp_matches(x, '^0[0-9]+$'))) = 0 AS valid,
  CASE WHEN len(list_filter(string_split(pre, '.'), lambda x: regexp_matches(x, '^0[0-9]+$'))) = 0 THEN split_part(version, '.', 1)::BIGINT END AS major,
  CASE WHEN len(list_filter(string_split(pre, '.'), lambda x: regexp_matches(x, '^0[0-9]+$'))) = 0 THEN pre END AS pre FROM p
""",
)
def semver_parse(t):
    k = F.col("p_partkey")
    pre = F.when(k % 5 == 0, F.concat(F.lit("-beta.0"), (k % 10).cast("string"))).when(k % 5 == 1, F.concat(F.lit("-rc."), (k % 4).cast("string"))).otherwise("")
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (k % 7).cast("string"), F.lit(".0"), pre)
    parsed = t("part").select("p_partkey", version.alias("version")).withColumn("v", text.semver(F.col("version")))
    return parsed.select("p_partkey", "version", F.col("v").isNotNull().alias("valid"), F.col("v.major").alias("major"), F.col("v.pre").alias("pre"))


@QUERIES.add(
    "render_context",
    "SELECT lang, source, sha256(string_agg('ITEM' || chr(9) || doc_id || chr(9) || n_chars, chr(10) ORDER BY n_chars, doc_id)) AS context_sha256 FROM documents GROUP BY lang, source",
)
def render_context(t):
    line = F.concat_ws("\t", F.lit("ITEM"), F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return retrieval.render_context(t("documents"), ["lang", "source"], ["n_chars", "doc_id"], line).select("lang", "source", F.sha2("context", 256).alias("context_sha256"))
