"""Readers of JSON, JSONL, text, packed vectors and capsules; writers of text, JSONL and bundles."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.functions.hashing import DIMENSION, canonical_json, pack_f16


class SourceInvalid(ValueError):
    """A file that cannot be read as what it should be."""


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file by an explicit schema; anything else fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str):
    """A small JSON document as Python values, by way of Spark so that any store will do."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise SourceInvalid(f"{path}: one file is expected")
    try:
        return json.loads(rows[0][0])
    except ValueError as e:
        raise SourceInvalid(f"{path}: {e}") from e


def read_jsonl(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(line, value, is_object): lines of each file by number, blank ones left out; is_object is false for anything but an object.

    Files are read in splits. A line's number is its place in the split and how many lines the splits before it have,
    so only a count a split is brought together. With ``parts``, the files are the parts of one text, as ``write_parts`` leaves them,
    and the numbers run on over them.
    """
    placed = F.monotonically_increasing_id().alias("place")
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), placed)
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    by = Window.orderBy(F.length("file"), "file", "start") if parts else Window.partitionBy("file").orderBy("start")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    value = F.trim("value")
    parsed = F.try_parse_json(value)
    lines = rows.where(value != "").join(splits, ["file", "start"])
    return lines.select((F.col("place") + F.col("shift")).alias("line"), value.alias("value"), (parsed.isNotNull() & value.startswith("{")).alias("is_object"))


def jsonl_objects(spark: SparkSession, path: str, schema: str, key: str | None = None, parts: bool = False) -> DataFrame:
    """The objects of a JSONL file by a schema; refuses other lines and, if a key is named, repeated ones."""
    lines = read_jsonl(spark, path, parts)
    bad = lines.where("not is_object").agg(F.min("line")).first()[0]
    if bad is not None:
        raise SourceInvalid(f"{path}: line {bad} is not an object")
    rows = lines.select("line", F.from_json("value", schema).alias("x")).select("line", "x.*")
    if key and not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise SourceInvalid(f"{path}: a {key} is repeated")
    return rows


def explode_collections(document: DataFrame, collections: list[str]) -> DataFrame:
    """(collection, ordinal, record) of a wrapper's arrays, which share one element type."""
    parts = [document.select(F.lit(c).alias("collection"), F.posexplode(c).alias("ordinal", "record")) for c in collections]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def wrapper_payload(document: Column, collections: list[str]) -> Column:
    """A map of a wrapper's entries without its collections."""
    return F.map_filter(document, lambda k, _: ~k.isin(collections))


def unified_items(records: DataFrame) -> DataFrame:
    """(item_id, kind, source_path, payload, priority): events without an id get one from their place."""
    made = F.format_string("event:%s:%06d", F.col("path"), F.col("ordinal"))
    kind = F.coalesce(F.nullif("record_type", F.lit("")), F.lit("record"))
    item_id = F.coalesce(F.nullif("id", F.lit("")), F.when(kind == "event", made))
    return records.select(item_id.alias("item_id"), kind.alias("kind"), F.col("path").alias("source_path"), canonical_json("payload").alias("payload")).withColumn(
        "priority", priority(F.col("kind"), F.col("source_path"))
    )


def priority(kind: Column, source_path: Column) -> Column:
    """0 for what must be known first, 3 for the rest; a wrapper goes with what it wraps."""
    wrapper = kind == "wrapper"
    return (
        F.when(kind.isin("identity", "organization", "term") | (wrapper & source_path.isin("identity/public.json", "terminology/index.json", "context/public.json")), 0)
        .when(kind.isin("claim", "project", "publication", "research_topic") | (wrapper & source_path.isin("projects/index.json", "publications/index.json")), 1)
        .when(kind.isin("relationship", "event", "wrapper"), 2)
        .otherwise(3)
    )


# The guards of items, by what they are marked with.
TAG_GUARDS = (
    (("satire",), "SATIRE != BIOGRAPHY"),
    (("formalization", "formal-assurance", "lean4", "formal-protocol"), "FORMALIZATION != PHYSICAL_TRUTH"),
    (("ai-observation", "transcript", "model-evaluation"), "OBSERVED_OR_ARCHIVED_MODEL_OUTPUT != GENERAL_MODEL_IDENTITY"),
)
OMISSION_GUARD = "REGISTRY_OMISSION != NEGATIVE_FACT"
STATUS_GUARD = "UNASSERTED_LEGAL_OR_CORPORATE_STATUS != FALSE"


def tag_guards(tags: Column) -> Column:
    """The guards that an item's tags call for, in their order."""
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(low, F.array(*map(F.lit, names))), F.lit(guard)) for names, guard in TAG_GUARDS)))


def boundary_guards(kind: Column, source_path: Column, tags: Column, completeness: Column, legal_status: Column) -> Column:
    """The guards of an item: by completeness for registries, by status for organisations, by tags for projects."""
    registry = (kind == "wrapper") & source_path.isin("projects/index.json", "publications/index.json")
    partial = F.lower(completeness).contains("not_exhaustive") | F.lower(completeness).contains("selective")
    none = F.array().cast("array<string>")
    return (
        F.when(registry & partial, F.array(F.lit(OMISSION_GUARD)))
        .when((kind == "organization") & (legal_status == "not_asserted_by_substrate"), F.array(F.lit(STATUS_GUARD)))
        .when(kind == "project", tag_guards(tags))
        .otherwise(none)
    )


def read_capsule(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items: kind, source_path, payload) and (boundaries: item_id, guard) of a tab-delimited capsule."""
    lines = spark.read.text(path).select(F.split("value", "\t", 4).alias("f"))
    items = lines.where("f[0] = 'ITEM' and size(f) = 4").select(F.col("f")[1].alias("kind"), F.col("f")[2].alias("source_path"), F.col("f")[3].alias("payload"))
    guards = lines.where("f[0] = 'BOUNDARY' and size(f) = 3").select(F.col("f")[1].alias("item_id"), F.col("f")[2].alias("guard"))
    return items, guards


def read_vectors(spark: SparkSession, path: str, dimension: int = DIMENSION, split_bytes: int = 64 << 20) -> DataFrame:
    """(vector_index, embedding) of a packed file of 16-bit little-endian floats.

    Splits of about ``split_bytes`` begin at whole vectors, and a vector's index is its place in the file, so a file of any size
    is read by many tasks.
    """
    width = 2 * dimension
    for r in spark.read.format("binaryFile").load(path).select("length").collect():
        if r["length"] % width:
            raise SourceInvalid(f"{r['length']} bytes are not whole vectors of {dimension}")
    records = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.spark.input.FixedLengthBinaryInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(width), "mapreduce.input.fileinputformat.split.maxsize": str(split_bytes)},
    )

    def unpack(batches):
        for frame in batches:
            matrix = np.frombuffer(b"".join(frame["v"]), "<f2").reshape(-1, dimension).astype(np.float64)
            yield pd.DataFrame({"vector_index": frame["i"], "embedding": list(matrix)})

    rows = spark.createDataFrame(records.map(lambda r: (r[0], bytearray(r[1]))), "i long, v binary")
    return rows.mapInPandas(unpack, "vector_index int, embedding array<double>")


def write_text(rows: DataFrame, path: str, order: list[str], line: Column) -> None:
    """One text file of the lines in order; for reports and manifests, which are small."""
    rows.orderBy(*order).select(line.alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def write_parts(rows: DataFrame, path: str, order: list[str], line: Column) -> None:
    """The lines in order as one text in many files, whose names are in the order of their parts.

    Each task sorts and writes a range of its own, so no task holds or sees the whole.
    """
    rows.select(*(F.col(c).alias(f"at{i}") for i, c in enumerate(order)), line.alias("value")).orderBy(*(f"at{i}" for i in range(len(order)))).select("value").write.mode("errorifexists").text(path)


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None, parts: bool = False) -> None:
    """Canonical JSON lines; in one ordered file only if an order is asked for, or in ordered ``parts``."""
    value = canonical_json(F.to_json(F.struct(*rows.columns))).alias("value")
    if order:
        (write_parts if parts else write_text)(rows, path, order, value)
    else:
        rows.select(value).write.mode("errorifexists").text(path)


#: Bytes of a packed file that are written at a time.
CHUNK = 4 << 20


def write_vectors(rows: DataFrame, path: str, vector: str = "embedding", order: str = "vector_index") -> None:
    """Packed 16-bit little-endian vectors in their order, one binary file.

    Tasks sort and pack; the file is one stream, so its chunks pass through the driver one after another.
    """

    def chunks(batches):
        held, size = [], 0
        for frame in batches:
            for v in frame["v"]:
                held.append(v)
                size += len(v)
                if size >= CHUNK:
                    yield pd.DataFrame({"chunk": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"chunk": [b"".join(held)]})

    packed = rows.orderBy(order).select(pack_f16(vector).alias("v")).mapInPandas(chunks, "chunk binary")
    conf = rows.sparkSession._jsc.hadoopConfiguration()
    at = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, False)
    try:
        for r in packed.toLocalIterator(prefetchPartitions=True):
            out.write(bytearray(r["chunk"]))
    finally:
        out.close()


def markdown_facts(title: str, facts: dict[str, object], note: str = "") -> str:
    """A report of named figures: a heading, a bullet for each, and a note; what is null shows as n/a."""
    shown = lambda v: "n/a" if v is None else v
    return "\n".join([f"# {title}", "", *(f"- {k}: `{shown(v)}`" for k, v in facts.items()), *(["", f"> {note}"] if note else []), ""])


def publish(spark: SparkSession, staging: str, target: str) -> None:
    """Put a finished folder in its place by one rename; refuses a target that is there."""
    source, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, target))
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to):
        raise SourceInvalid(f"{target} is there already")
    if not fs.rename(source, to):
        raise SourceInvalid(f"{staging} cannot be moved to {target}")


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small DataFrame as a markdown table; refuses one of more than ``most`` rows, which is no report."""
    head = rows.columns
    body = rows.limit(most + 1).collect()
    if len(body) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "n/a" if v is None else str(v)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in body)]) + "\n"


def struct_of(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)
