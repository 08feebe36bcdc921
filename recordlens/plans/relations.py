"""Queries over references, duplicates, contracts, order and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordlens.functions.hashing import sha256
from recordlens.functions.text import collapse
from recordlens.operators import budget, bundle, graph, reach, relations
from recordlens.plans.catalogue import Catalogue

QUERIES = Catalogue()


def _id(kind: str, *columns: str):
    return F.concat_ws(":", F.lit(kind), *(F.col(c).cast("string") for c in columns))


def _geo_edges(t):
    customers = t("customer").select(_id("customer", "c_custkey").alias("src"), _id("nation", "c_nationkey").alias("dst"))
    nations = t("nation").select(_id("nation", "n_nationkey").alias("src"), _id("region", "n_regionkey").alias("dst"))
    return customers.unionByName(nations)


_GEO = """
  SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation"""
_CLOSURE = """
WITH RECURSIVE e AS ({edges}), c AS (SELECT id FROM ({seeds}) UNION SELECT dst FROM c JOIN e ON c.id = e.src)
SELECT id FROM c"""


@QUERIES.add("closure_geo", _CLOSURE.format(edges=_GEO, seeds="SELECT 'customer:' || c_custkey AS id FROM customer"))
def closure_geo(t):
    return graph.closure(t("customer").select(_id("customer", "c_custkey").alias("id")), _geo_edges(t))


_ORDERS = (
    _GEO
    + """
  UNION ALL SELECT 'line:' || l_orderkey || ':' || l_linenumber, 'order:' || l_orderkey FROM lineitem
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders"""
)


@QUERIES.add("closure_orders", _CLOSURE.format(edges=_ORDERS, seeds="SELECT 'line:' || l_orderkey || ':' || l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R'"))
def closure_orders(t):
    lines = t("lineitem").select(_id("line", "l_orderkey", "l_linenumber").alias("src"), _id("order", "l_orderkey").alias("dst"))
    orders = t("orders").select(_id("order", "o_orderkey").alias("src"), _id("customer", "o_custkey").alias("dst"))
    seeds = t("lineitem").where("l_returnflag = 'R'").select(_id("line", "l_orderkey", "l_linenumber").alias("id"))
    return graph.closure(seeds, _geo_edges(t).unionByName(lines).unionByName(orders))


@QUERIES.add("dangling_refs", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def dangling_refs(t):
    return relations.dangling(t("orders"), "o_custkey", t("customer").where("c_acctbal >= 0"), "c_custkey").select("o_orderkey", "o_custkey")


@QUERIES.add("unlabelled_docs", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_docs(t):
    return relations.dangling(t("documents").select("doc_id", "lang"), "doc_id", t("labels"), "doc_id")


@QUERIES.add("labelled_docs", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_docs(t):
    return relations.resolved(t("documents").select("doc_id", "lang"), "doc_id", t("labels"), "doc_id")


_KEYS = [
    ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"),
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels_documents", "labels", "doc_id", "documents", "doc_id"),
    ("documents_labels", "documents", "doc_id", "labels", "doc_id"),
]


@QUERIES.add(
    "fk_report",
    " UNION ALL ".join(
        f"SELECT '{n}' AS check_name, (SELECT count(*) FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})) AS violations" for n, c, k, p, pk in _KEYS
    ),
)
def fk_report(t):
    return relations.reference_report([(n, t(c), k, t(p), pk) for n, c, k, p, pk in _KEYS])


@QUERIES.add("duplicate_text", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_text(t):
    return relations.duplicates(t("documents").select("doc_id", sha256(F.col("text")).alias("digest")), "digest", "doc_id")


@QUERIES.add(
    "first_wins", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_later FROM documents"
)
def first_wins(t):
    return relations.first_wins(t("documents").select("doc_id", sha256(F.col("text")).alias("digest")), "digest", "doc_id").select("doc_id", "is_later")


@QUERIES.add(
    "alias_collision",
    r"""WITH p AS (SELECT p_partkey, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS norm FROM part),
f AS (SELECT norm, min(p_partkey) AS first_owner FROM p GROUP BY norm)
SELECT p_partkey, norm, first_owner FROM p JOIN f USING (norm) WHERE p_partkey <> first_owner""",
)
def alias_collision(t):
    return relations.collisions(t("part").select("p_partkey", collapse(F.col("p_name")).alias("norm")), "norm", "p_partkey")


_KINDS = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))


@QUERIES.add(
    "id_prefix_rule",
    "SELECT kind, id FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{k}:' || {c} AS id FROM {k}" for k, c in _KINDS)
    + ") WHERE NOT starts_with(id, CASE kind WHEN 'supplier' THEN 'vendor:' ELSE kind || ':' END)",
)
def id_prefix_rule(t):
    rows = [t(k).select(F.lit(k).alias("kind"), _id(k, c).alias("id")) for k, c in _KINDS]
    prefix = F.when(F.col("kind") == "supplier", "vendor:").otherwise(F.concat("kind", F.lit(":")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).where(~F.col("id").startswith(prefix))


@QUERIES.add(
    "chronology_order",
    """WITH s AS (SELECT *, (props->>'$.k')::BIGINT * 1000000000 + event_id AS seq FROM events),
o AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY seq) AS previous FROM s)
SELECT event_id, user_id FROM o WHERE ts < previous""",
)
def chronology_order(t):
    seq = F.get_json_object("props", "$.k").cast("long") * 1_000_000_000 + F.col("event_id")
    return relations.order_violations(t("events").withColumn("seq", seq), ["user_id"], "seq", "ts").select("event_id", "user_id")


@QUERIES.add(
    "turn_contract",
    """WITH c AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, max(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(role = before)::BIGINT AS repeats FROM c GROUP BY conv_id""",
)
def turn_contract(t):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t("conversations").select("conv_id", "turn", "role", before.alias("before"))
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), (F.max("turn") + 1 - F.count_distinct("turn")).alias("gaps"), F.count_if(F.col("role") == F.col("before")).alias("repeats")
    )


@QUERIES.add(
    "release_match",
    """SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), false) AS returned, coalesce(bool_or(l_returnflag = 'R' AND l_quantity >= 25), false) AS bulk,
coalesce(bool_or(l_returnflag = 'R' AND l_quantity >= 25 AND l_discount >= 0.05), false) AS discounted
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def release_match(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity", "l_discount")
    conditions = {"returned": F.col("l_returnflag") == "R", "bulk": F.col("l_quantity") >= 25, "discounted": F.col("l_discount") >= 0.05}
    return relations.progressive_match(t("orders").select("o_orderkey"), lines, "o_orderkey", conditions)


@QUERIES.add(
    "status_counts",
    """SELECT v.event_type, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['click', 'view', 'purchase', 'refund', 'signup', 'error', 'logout']) AS event_type) v
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e USING (event_type)""",
)
def status_counts(t):
    return relations.zero_filled(t("events"), "event_type", ["click", "view", "purchase", "refund", "signup", "error", "logout"])


@QUERIES.add(
    "contract_join",
    """WITH e AS (SELECT doc_id, count(*) AS expected_n FROM documents GROUP BY 1), a AS (SELECT doc_id, count(*) AS actual_n FROM labels GROUP BY 1)
SELECT doc_id, coalesce(expected_n, 0)::BIGINT AS expected_n, coalesce(actual_n, 0)::BIGINT AS actual_n,
CASE WHEN coalesce(expected_n, 0) = 0 THEN 'unknown' WHEN coalesce(actual_n, 0) = 0 THEN 'missing' WHEN expected_n > 1 OR actual_n > 1 THEN 'duplicate' ELSE 'matched' END AS status
FROM e FULL JOIN a USING (doc_id)""",
)
def contract_join(t):
    return relations.contract(t("documents"), t("labels"), "doc_id")


@QUERIES.add(
    "adjacency_trap",
    """WITH c AS (SELECT *, length(text) > 400 AS long FROM conversations)
SELECT conv_id, turn FROM c WHERE NOT long AND conv_id IN (SELECT conv_id FROM c WHERE long)""",
)
def adjacency_trap(t):
    return relations.adjacent_to(t("conversations"), "conv_id", F.char_length("text") > 400).select("conv_id", "turn")


@QUERIES.add(
    "upsert",
    """SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier
UNION ALL SELECT -n_nationkey - 1, 'House of ' || n_name, n_nationkey, 0.0 FROM nation""",
)
def upsert(t):
    zero = F.lit(0.0).alias("s_acctbal")
    settled = t("supplier").where("s_acctbal < 0").select("s_suppkey", "s_name", "s_nationkey", zero)
    houses = t("nation").select(
        (-F.col("n_nationkey") - 1).cast("long").alias("s_suppkey"), F.concat(F.lit("House of "), "n_name").alias("s_name"), F.col("n_nationkey").alias("s_nationkey"), zero
    )
    return relations.upsert(t("supplier"), settled.unionByName(houses), "s_suppkey")


@QUERIES.add(
    "set_compare",
    """WITH a AS (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS l FROM part WHERE p_size <= 25 GROUP BY 1),
b AS (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS r FROM part WHERE p_size > 25 GROUP BY 1)
SELECT p_type, list_has_any(l, r) AS overlap, len(list_filter(l, lambda x: NOT list_contains(r, x))) = 0 AS left_is_subset, l = r AS same_set, l = r AS same_multiset
FROM a JOIN b USING (p_type)""",
)
def set_compare(t):
    brands = lambda where, name: t("part").where(where).groupBy("p_type").agg(F.collect_set("p_brand").alias(name))
    both = brands("p_size <= 25", "l").join(brands("p_size > 25", "r"), "p_type")
    return both.select("p_type", relations.set_relations(F.col("l"), F.col("r")).alias("x")).select("p_type", "x.*")


@QUERIES.add(
    "symmetric_difference",
    """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""",
)
def symmetric_difference(t):
    rich = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return relations.symmetric_difference(rich, t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")))


@QUERIES.add(
    "fileset_diff",
    """WITH d AS (SELECT 'o/' || o_orderkey AS path, o_orderpriority AS h FROM orders WHERE o_orderstatus IN ('O', 'F')),
a AS (SELECT 'o/' || o_orderkey AS path, CASE WHEN o_totalprice > 400000 THEN 'x' ELSE o_orderpriority END AS h FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT path, CASE WHEN a.h IS NULL THEN 'missing' WHEN d.h IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM d FULL JOIN a USING (path) WHERE a.h IS DISTINCT FROM d.h""",
)
def fileset_diff(t):
    orders = t("orders").withColumn("path", F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")))
    declared = orders.where(F.col("o_orderstatus").isin("O", "F")).select("path", F.col("o_orderpriority").alias("sha256"))
    actual = orders.where(F.col("o_orderstatus").isin("O", "P")).select("path", F.when(F.col("o_totalprice") > 400000, "x").otherwise(F.col("o_orderpriority")).alias("sha256"))
    return relations.fileset_difference(declared, actual)


@QUERIES.add(
    "bundle_hash",
    """WITH f AS (SELECT r_name AS grp, 'nation/' || n_name AS path, sha256(n_name || ':' || n_nationkey) AS sha256, length(n_name) AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT grp, sha256(string_agg(path || chr(0) || sha256 || chr(0) || bytes || chr(10), '' ORDER BY path)) AS bundle_sha256 FROM f GROUP BY grp""",
)
def bundle_hash(t):
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = joined.select(
        F.col("r_name").alias("grp"), F.concat(F.lit("nation/"), "n_name").alias("path"),
        sha256(F.concat_ws(":", "n_name", F.col("n_nationkey").cast("string"))).alias("sha256"), F.char_length("n_name").alias("bytes"),
    )
    return bundle.bundle_digest(entries, ["grp"])


_ITEM_SQL = """
  SELECT 'region:' || r_regionkey AS item_id, 'source' AS kind, 3 AS priority, 'sources' AS source_path, 200 + length(r_name) AS cost, NULL AS ref, NULL AS source, NULL AS target FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'project', 1, 'projects', 100 + n_nationkey, 'region:' || n_regionkey, NULL, NULL FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'publication', 2, 'publications', 30 + s_suppkey % 70, 'nation:' || s_nationkey, NULL, NULL FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'claim', 2 - c_custkey % 2, 'claims', 20 + c_custkey % 50, 'nation:' || c_nationkey, NULL, NULL FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'relationship', 2 + o_orderkey % 2, 'orders', 15 + o_orderkey % 9, NULL, 'customer:' || o_custkey, 'customer:' || (o_custkey * 7 % 150) FROM orders WHERE o_orderkey % 8 = 0"""


def _dependent_items(t):
    """Items of five kinds with what they refer to; relationships have ends, the others references."""
    none = F.lit(None).cast("string")

    def rows(table, key, kind, priority, path, cost, ref=none, source=none, target=none):
        return t(table).select(
            _id(table if table != "orders" else "order", key).alias("item_id"), F.lit(kind).alias("kind"), priority.cast("int").alias("priority"), F.lit(path).alias("source_path"),
            cost.cast("int").alias("cost"), F.array_compact(F.array(ref)).alias("source_refs"), source.alias("source"), target.alias("target"),
        )

    c = F.col
    orders = rows("orders", "o_orderkey", "relationship", 2 + c("o_orderkey") % 2, "orders", 15 + c("o_orderkey") % 9, none, _id("customer", "o_custkey"), F.concat(F.lit("customer:"), (c("o_custkey") * 7 % 150).cast("string")))
    return (
        rows("region", "r_regionkey", "source", F.lit(3), "sources", 200 + F.char_length("r_name"))
        .unionByName(rows("nation", "n_nationkey", "project", F.lit(1), "projects", 100 + c("n_nationkey"), _id("region", "n_regionkey")))
        .unionByName(rows("supplier", "s_suppkey", "publication", F.lit(2), "publications", 30 + c("s_suppkey") % 70, _id("nation", "s_nationkey")))
        .unionByName(rows("customer", "c_custkey", "claim", 2 - c("c_custkey") % 2, "claims", 20 + c("c_custkey") % 50, _id("nation", "c_nationkey")))
        .unionByName(orders.where(F.split("item_id", ":")[1].cast("long") % 8 == 0))
    )


_DEPENDENCY_SQL = f"""
  SELECT item_id AS src, ref AS dst FROM ({_ITEM_SQL}) WHERE ref IS NOT NULL
  UNION SELECT item_id, unnest([source, target]) FROM ({_ITEM_SQL}) WHERE kind = 'relationship'
  UNION SELECT item_id, 'wrapper:' || source_path FROM ({_ITEM_SQL}) WHERE source_path IN ('projects', 'publications')
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || (s_suppkey % 40) FROM supplier WHERE s_suppkey % 40 IN (SELECT n_nationkey FROM nation)"""


def _dependency_rows(t):
    """(items, edges) with wrappers as items, and names of nations in the suppliers' texts."""
    items = _dependent_items(t)
    wrappers = items.where(F.col("source_path").isin("projects", "publications")).select("source_path", F.concat(F.lit("wrapper:"), "source_path").alias("wrapper_id")).distinct()
    named = t("supplier").select(_id("supplier", "s_suppkey").alias("item_id"), F.concat(F.lit("nation:"), (F.col("s_suppkey") % 40).cast("string")).alias("value"))
    own = named.select("item_id", F.col("item_id").alias("value"))
    return items, wrappers, graph.dependency_edges(items, wrappers, named.unionByName(own))


@QUERIES.add("dependency_edges", f"SELECT src, dst FROM ({_DEPENDENCY_SQL})")
def dependency_edges(t):
    return _dependency_rows(t)[2].select("src", "dst")


@QUERIES.add(
    "select_dependencies",
    f"""
WITH RECURSIVE items AS (
  SELECT item_id, kind, priority, source_path, cost FROM ({_ITEM_SQL})
  UNION ALL SELECT DISTINCT 'wrapper:' || source_path, 'wrapper', 0, source_path, 50 FROM ({_ITEM_SQL}) WHERE source_path IN ('projects', 'publications')
), e AS ({_DEPENDENCY_SQL}), c AS (SELECT item_id AS seed, item_id AS id FROM items UNION SELECT seed, dst FROM c JOIN e ON c.id = src),
needs AS (SELECT seed, list({{'id': id, 'cost': cost}}) AS a FROM c JOIN items ON id = item_id GROUP BY seed),
o AS (
  SELECT row_number() OVER (ORDER BY priority, CASE kind WHEN 'wrapper' THEN 0 WHEN 'claim' THEN 3 WHEN 'project' THEN 4 WHEN 'publication' THEN 5 WHEN 'relationship' THEN 7 ELSE 9 END, source_path, item_id) AS rn, a
  FROM items JOIN needs ON seed = item_id
), f AS (
  SELECT profile, 0::BIGINT AS rn, room::BIGINT AS room, []::VARCHAR[] AS taken FROM (VALUES ('MICRO', 8192), ('STANDARD', 24576)) AS p(profile, room)
  UNION ALL
  SELECT profile, rn, CASE WHEN price <= room THEN room - price ELSE room END, CASE WHEN price <= room THEN list_concat(taken, list_transform(more, lambda x: x.id)) ELSE taken END
  FROM (
    SELECT profile, rn, room, taken, more, coalesce(list_sum(list_transform(more, lambda x: x.cost)), 0)::BIGINT AS price
    FROM (SELECT f.profile, o.rn, f.room, f.taken, list_filter(o.a, lambda x: NOT list_contains(f.taken, x.id)) AS more FROM f JOIN o ON o.rn = f.rn + 1))
)
SELECT profile, unnest(taken) AS item_id FROM f WHERE rn = (SELECT max(rn) FROM o)
UNION ALL SELECT 'FULL', item_id FROM items
""",
)
def select_dependencies(t):
    items, wrappers, edges = _dependency_rows(t)
    columns = ["item_id", "kind", "priority", "source_path", "cost"]
    heads = wrappers.select(F.col("wrapper_id").alias("item_id"), F.lit("wrapper").alias("kind"), F.lit(0).alias("priority"), "source_path", F.lit(50).alias("cost"))
    every = items.select(*columns).unionByName(heads)
    return budget.select_with_dependencies(every, edges, {"MICRO": 8192, "STANDARD": 24576, "FULL": 1 << 40})


_RING = (
    _GEO
    + """
  UNION ALL SELECT 'nation:' || a.n_nationkey, 'nation:' || b.n_nationkey FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25"""
)


@QUERIES.add(
    "reachable_sets",
    f"""WITH RECURSIVE e AS ({_RING}), c AS (SELECT 'customer:' || c_custkey AS seed, 'customer:' || c_custkey AS id FROM customer UNION SELECT seed, dst FROM c JOIN e ON id = src)
SELECT seed, id FROM c""",
)
def reachable_sets(t):
    """What every customer leads to, where nations lead on to others in rings."""
    nations = t("nation")
    following = nations.select(((F.col("n_nationkey") + 20) % 25).alias("before"), F.col("n_nationkey").alias("after"))
    ring = nations.join(following, F.col("n_nationkey") == F.col("before")).select(_id("nation", "n_nationkey").alias("src"), _id("nation", "after").alias("dst"))
    return reach.Reach(_geo_edges(t).unionByName(ring)).of_seeds(t("customer").select(_id("customer", "c_custkey").alias("id")))
