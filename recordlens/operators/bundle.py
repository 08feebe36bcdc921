"""Reproducible bundles: manifests, digests, and comparison of what is there with what should be."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import canonical, canonical_json, manifest_line, ordered_hash, sha256
from recordlens.functions.text import between_markers, is_commit, is_digest, safe_path
from recordlens.operators.relations import all_findings, fileset_difference, findings


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of (path, content), in no order."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def bundle_digest(entries: DataFrame, by: list[str] | None = None, name: str = "bundle_sha256") -> DataFrame:
    """The digest over the manifest's lines in the order of their paths, per group if asked."""
    return ordered_hash(entries, ["path"], manifest_line(F.col("path"), F.col("sha256"), F.col("bytes")), by, name)


def bundle_findings(declared: DataFrame, actual: DataFrame, rebuilt: DataFrame | None = None, family: str = "bundle") -> DataFrame:
    """Findings on a bundle: unsafe paths, files that lack, are not declared, or differ from manifest or rebuild."""
    unsafe = findings(declared.where(~F.coalesce(safe_path(F.col("path")), F.lit(False))), f"{family}.path", F.col("path"), F.lit("path is not safe"))
    parts = [unsafe]
    for code, wanted in ((f"{family}.files", declared), (f"{family}.rebuild", rebuilt)):
        if wanted is not None:
            differences = fileset_difference(wanted, actual)
            parts.append(findings(differences, code, F.col("path"), F.col("status")))
    return all_findings(parts)


def identity_disagreement(components: DataFrame, fields: list[str]) -> DataFrame:
    """One row: whether all components agree on the fields, and how many identities there are."""
    return components.agg(F.count_distinct(F.struct(*fields)).alias("identities")).withColumn("agree", F.col("identities") == 1)


def projection_files(body: str, templates: DataFrame, begin: str = "BEGIN_PROJECTION", end: str = "END_PROJECTION") -> DataFrame:
    """The same body in each transport's template (adapter_id, path, preamble), between markers."""
    text = F.concat(F.coalesce("preamble", F.lit("")), F.lit(f"{begin}\n{body}{end}\n"))
    return templates.select("adapter_id", "path", text.alias("content"))


def projection_findings(files: DataFrame, body: str, begin: str = "BEGIN_PROJECTION", end: str = "END_PROJECTION") -> DataFrame:
    """Findings on transports whose marked body is missing or another."""
    found: Column = between_markers(F.col("content"), f"{begin}\n", f"{end}\n")
    bad = files.where(found.isNull() | (sha256(found) != F.sha2(F.lit(body), 256)))
    return findings(bad, "adapter.projection", F.col("path"), F.lit("the projection differs"))


def checksum_lines(files: DataFrame, name: str = "path") -> DataFrame:
    """(line) of a checksum file for (path, content): digest, two spaces, name; ordered by name."""
    return files.select(F.concat(F.sha2("content", 256), F.lit("  "), F.col(name)).alias("line"), F.col(name).alias("__n")).orderBy("__n").select("line")


def checksum_findings(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Differences between a checksum file's lines and what they should be."""
    want = checksum_lines(files)
    return all_findings([
        findings(want.exceptAll(lines.select("line")), "release.checksums", F.substr("line", F.lit(67)), F.lit("line lacks")),
        findings(lines.select("line").exceptAll(want), "release.checksums", F.substr("line", F.lit(67)), F.lit("line is not called for")),
    ])


def paths_overlap(a: Column, b: Column) -> Column:
    """Whether one of two normal paths is the other or lies above it."""
    return (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def snapshot_identity(date: Column, commit: Column, digest: Column) -> Column:
    """snapshot-<date>@git:<commit>@sha256:<digest>; null unless commit and digest are whole lower-case ones."""
    return F.when(is_commit(commit) & is_digest(digest), F.concat(F.lit("snapshot-"), date, F.lit("@git:"), commit, F.lit("@sha256:"), digest))


def release_fingerprint(payload: Column | str, own: str = "release_sha256") -> Column:
    """The digest of a release's canonical JSON without the field that holds it."""

    def run(payload: pd.Series) -> pd.Series:
        def one(s):
            value = json.loads(s)
            value.pop(own, None)
            return hashlib.sha256((canonical(value) + "\n").encode()).hexdigest()

        return payload.map(lambda s: None if s is None else one(s))

    return F.pandas_udf(run, "string")(payload)


def reproducibility_source(path: Column, folders: list[str], files: list[str]) -> Column:
    """Whether a path is one that a build must find committed: a listed file, or below a listed folder."""
    normal = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")
    return normal.isin(*files) | F.split(normal, "/")[0].isin(*folders)


def meaningful_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines of a version control status that matter: compiled files and their folders don't."""
    text = F.trim(line)
    path = F.when(F.length(text) > 3, F.substr(text, F.lit(4))).otherwise(text)
    return lines.select(text.alias("line")).where((text != "") & ~F.contains(path, F.lit("/__pycache__/")) & ~path.endswith(".pyc"))


def identity_header(title: str, fields: dict[str, Column | str], rules: tuple[str, ...] = ()) -> Column:
    """A block of NAME=value lines below a title, with fixed lines after them; nulls show as nothing."""
    lines = [F.lit(title), *(F.concat(F.lit(f"{k}="), F.coalesce(v if isinstance(v, Column) else F.lit(v), F.lit(""))) for k, v in fields.items()), *map(F.lit, rules), F.lit("")]
    return F.concat_ws("\n", *lines)


def projection_body(sections: DataFrame, head: list[str]) -> DataFrame:
    """(body): a title's lines, and under each group's heading its files in order, each between FILE= and END_FILE= lines.

    ``sections``: (group: place of the group, heading, ordinal, path, content). The body is one public text by nature.
    """
    block = F.concat(F.lit("FILE="), "path", F.lit("\n"), F.rtrim("content", F.lit("\n")), F.lit("\nEND_FILE="), "path", F.lit("\n"))
    rows = sections.select("group", "ordinal", "heading", block.alias("block"))
    packed = F.array_sort(F.collect_list(F.struct("ordinal", "block")))
    groups = rows.groupBy("group", "heading").agg(F.array_join(F.transform(packed, lambda x: x["block"]), "\n").alias("text"))
    whole = F.array_sort(F.collect_list(F.struct("group", F.concat("heading", F.lit("\n"), "text").alias("text"))))
    body = groups.agg(F.array_join(F.transform(whole, lambda x: x["text"]), "\n").alias("body"))
    return body.select(F.concat(F.lit("\n".join(head) + "\n"), F.rtrim("body", F.lit("\n ")), F.lit("\n")).alias("body"))


def transports(body: str, definitions: DataFrame, header: Column, begin: str, end: str) -> DataFrame:
    """(adapter_id, path, role, content): the same body for every transport, after its header and preamble, between markers.

    ``definitions``: (adapter_id, path, role, preamble). Which transports there are is the caller's.
    """
    text = F.concat(header, F.rtrim(F.coalesce("preamble", F.lit(""))), F.lit(f"\n\n{begin}\n{body}{end}\n"))
    return definitions.select("adapter_id", "path", "role", text.alias("content"))


def files_by_adapter(files: DataFrame) -> DataFrame:
    """(adapter_id, files: path, role, sha256, bytes): what each adapter is made of, by path."""
    entry = F.struct("path", "role", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    return files.groupBy("adapter_id").agg(F.array_sort(F.collect_list(entry)).alias("files"))


def archive_metadata(releases: DataFrame, constants: dict[str, str]) -> DataFrame:
    """(version, metadata: canonical JSON): a release's identity and archive status beside the caller's fixed fields."""
    own = ("version", "status", "doi", "source_commit", "content_sha256")
    packed = F.to_json(F.struct(*own, *(F.lit(v).alias(k) for k, v in constants.items())), {"ignoreNullFields": "false"})
    return releases.select("version", canonical_json(packed).alias("metadata"))
