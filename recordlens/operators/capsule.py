"""Capsules: canonical items in one text, and whether such a text says what the items do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import canonical_json, sha256
from recordlens.operators.budget import section_rank
from recordlens.operators.relations import all_findings, findings
from recordlens.sources.files import priority, unified_items


def wrapper_items(wrappers: DataFrame) -> DataFrame:
    """(item_id, kind, source_path, payload, priority) of wrappers (path, payload: JSON without the collections)."""
    kind, path = F.lit("wrapper"), F.col("path")
    return wrappers.where("payload is not null and payload <> '{}'").select(
        F.concat(F.lit("wrapper:"), path).alias("item_id"), kind.alias("kind"), path.alias("source_path"), canonical_json("payload").alias("payload"), priority(kind, path).alias("priority")
    )


def canonical_items(records: DataFrame, wrappers: DataFrame) -> DataFrame:
    """All items, records and wrappers; ``item_findings`` tells those without an identity or with another's."""
    return unified_items(records).unionByName(wrapper_items(wrappers))


def item_findings(items: DataFrame) -> DataFrame:
    return all_findings([
        findings(items.where("item_id is null"), "capsule.identity", F.col("source_path"), F.lit("an item has no identity")),
        findings(items.where("item_id is not null").groupBy("item_id").count().where("count > 1"), "capsule.duplicate", F.col("item_id"), F.lit("an identity is repeated")),
    ])


def require_items(items: DataFrame) -> None:
    bad = item_findings(items).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{b['message']}: {b['path']}" for b in bad))


def kind_counts(selected: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(kind, n) of the selected items, ordered by kind."""
    return selected.groupBy(*(by or []), "kind").agg(F.count(F.lit(1)).alias("n")).orderBy(*(by or []), "kind")


def item_line(kind: Column, path: Column, payload: Column) -> Column:
    return F.concat_ws("\t", F.lit("ITEM"), kind, path, payload)


def item_order(kind: str = "kind", path: str = "source_path", item_id: str = "item_id") -> list[Column]:
    """The four keys that items stand in a capsule by."""
    return [F.col("priority"), section_rank(F.col(kind)), F.col(path), F.col(item_id)]


def render_capsule(items: DataFrame, guards: DataFrame, head: list[str], tail: list[str], profile: str = "profile") -> DataFrame:
    """(profile, text): one capsule per profile: the head's lines, the items in their order, each with its guards, the tail's.

    ``items``: (profile, item_id, kind, source_path, payload, priority); ``guards``: (item_id, guard, ordinal). The head and
    tail are the caller's. A capsule has a token budget, so its text is one row by nature.
    """
    order = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(item_order())))
    own = items.select(profile, order.alias("at"), F.lit(-1).alias("nth"), item_line(F.col("kind"), F.col("source_path"), F.col("payload")).alias("line"))
    marked = items.join(guards, "item_id").select(profile, order.alias("at"), F.col("ordinal").cast("int").alias("nth"), F.concat_ws("\t", F.lit("BOUNDARY"), "item_id", "guard").alias("line"))
    packed = F.array_sort(F.collect_list(F.struct("at", "nth", "line")))
    body = own.unionByName(marked).groupBy(profile).agg(F.transform(packed, lambda x: x["line"]).alias("lines"))
    fixed = lambda lines: F.array(*map(F.lit, lines)).cast("array<string>")
    return body.select(profile, F.array_join(F.concat(fixed(head), "lines", fixed(tail)), "\n").alias("text"))


def profile_entry(capsules: DataFrame, items: DataFrame, selected: DataFrame, cost: Column, profile: str = "profile") -> DataFrame:
    """Per profile the capsule's portable tokens, bytes, digest, and how many items are in and left out."""
    counts = selected.groupBy(profile).agg(F.count(F.lit(1)).alias("included_items"))
    total = items.agg(F.count(F.lit(1)).alias("__all"))
    rows = capsules.join(counts, profile, "left").join(F.broadcast(total))
    inside = F.coalesce("included_items", F.lit(0).cast("long"))
    return rows.select(
        profile, cost.alias("portable_tokens"), F.octet_length("text").cast("long").alias("bytes"), sha256(F.col("text")).alias("sha256"),
        inside.alias("included_items"), (F.col("__all") - inside).alias("omitted_items"), (F.col("__all") != inside).alias("truncated"),
    )


def capsule_findings(parsed: DataFrame, boundaries: DataFrame, items: DataFrame, guards: DataFrame, by: str = "profile") -> DataFrame:
    """What a capsule's text says that its items don't, or the other way round.

    ``parsed``: (profile, item_id, kind, source_path, payload: canonical JSON, source_refs, source, target);
    ``boundaries``: (profile, item_id, guard); ``items``: the canonical ones; ``guards``: (item_id, guard) that they call for.
    Items must be canonical and untouched, cite only sources and join only ends that are in the same capsule, and have
    exactly their guards.
    """
    own = items.select("item_id", F.col("kind").alias("__kind"), F.col("source_path").alias("__path"), F.col("payload").alias("__payload"))
    joined = parsed.join(own, "item_id", "left")
    changed = joined.where("__kind is not null").where((F.col("kind") != F.col("__kind")) | (F.col("source_path") != F.col("__path")) | (F.col("payload") != F.col("__payload")))
    inside = parsed.select(by, F.col("item_id").alias("__end"), (F.col("kind") == "source").alias("__is_source"))
    refs = parsed.select(by, "item_id", F.explode("source_refs").alias("__end"))
    ends = parsed.where("kind = 'relationship'").select(by, "item_id", F.explode(F.array_compact(F.array("source", "target"))).alias("__end"))
    expected = parsed.select(by, "item_id").join(guards.select("item_id", "guard"), "item_id").select(by, "item_id", "guard").distinct()
    said = boundaries.select(by, "item_id", "guard").distinct()
    at = F.concat_ws("/", F.col(by), F.col("item_id"))
    return all_findings([
        findings(joined.where("__kind is null"), "capsule.unknown_item", at, F.lit("no canonical item")),
        findings(changed, "capsule.fact_transform", at, F.lit("differs from the canonical item")),
        findings(refs.join(inside.where("__is_source").drop("__is_source"), [by, "__end"], "left_anti"), "capsule.provenance_closure", at, F.concat(F.lit("source is not included: "), F.col("__end"))),
        findings(ends.join(inside.drop("__is_source"), [by, "__end"], "left_anti"), "capsule.relationship_closure", at, F.concat(F.lit("end is not included: "), F.col("__end"))),
        findings(expected.exceptAll(said), "capsule.boundaries", at, F.concat(F.lit("guard lacks: "), F.col("guard"))),
        findings(said.exceptAll(expected), "capsule.boundaries", at, F.concat(F.lit("guard is not called for: "), F.col("guard"))),
    ])


def retrieval_rows(items: DataFrame, search_text: Column) -> DataFrame:
    """The retrieval row of each item (vector_index, item_id, kind, source_path, payload): ids, digest, search text and metadata."""
    field = lambda n, kind="string": F.try_variant_get(F.parse_json("payload"), f"$.{n}", kind)
    refs = F.filter(F.coalesce(field("source_refs", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x) == "STRING")
    return items.select(
        F.concat(F.lit("chunk:"), "item_id").alias("chunk_id"), F.col("item_id").alias("canonical_id"), F.col("kind").alias("record_type"), "source_path", "vector_index",
        sha256(F.concat("payload", F.lit("\n"))).alias("content_sha256"), search_text.alias("search_text"),
        F.array_sort(F.transform(refs, lambda x: x.cast("string"))).alias("source_refs"), field("epistemic_state").alias("epistemic_state"), field("visibility").alias("visibility"),
    )


def in_base_order(rows: DataFrame, selected: DataFrame, key: str = "canonical_id", order: str = "vector_index") -> DataFrame:
    """The selected rows in the order of their index, not of their rank."""
    return rows.join(selected.select(F.col(key)).distinct(), key, "left_semi").orderBy(order)
