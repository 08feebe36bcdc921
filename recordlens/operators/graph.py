"""Dependency edges and transitive closure."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new one where it is unset and all executors are this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="recordlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, which ends its lineage."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Frontiers that are read one by one before they are written as one table.
FRONTIERS = 16


def _closure(start: DataFrame, edges: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """``start`` (keys, of which ``id`` is the last) and all that edges lead to, apart for the other keys.

    A frontier is joined to the edges, what is known is taken off, and the rest is the next frontier.
    Cycles end by themselves. Edges and frontiers are written once, so a lost executor costs no round and
    nothing that is known is written again, but for one table of every FRONTIERS.
    """
    links = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    known = [written(start.where("id is not null").distinct())]
    frontier = known[0]
    others = [k for k in keys if k != "id"]
    for _ in range(rounds):
        reached = frontier.join(links, F.col("id") == F.col("src")).select(*others, F.col("dst").alias("id")).distinct()
        frontier = written(reached.join(reduce(DataFrame.unionByName, known), keys, "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, known)
        known.append(frontier)
        if len(known) > FRONTIERS:
            known = [written(reduce(DataFrame.unionByName, known))]
    raise RuntimeError(f"no end of the closure after {rounds} rounds")


def closure(seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id): the seeds and all that edges (src, dst) lead to from them."""
    return _closure(seeds.select("id"), edges, ["id"], rounds)


def closure_by_seed(seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(seed, id): the same for every seed apart; as large as all closures together."""
    return _closure(seeds.select(F.col("id").alias("seed"), "id"), edges, ["seed", "id"], rounds)


def reference_edges(items: DataFrame) -> DataFrame:
    """(src, dst) by source_refs and, for relationships, their endpoints: what retrieval follows."""
    refs = items.select(F.col("item_id").alias("src"), F.explode("source_refs").alias("dst"))
    ends = items.where("kind = 'relationship'").select(F.col("item_id").alias("src"), F.explode(F.array("source", "target")).alias("dst"))
    return refs.unionByName(ends).distinct()


def dependency_edges(items: DataFrame, wrappers: DataFrame, strings: DataFrame) -> DataFrame:
    """What packing follows besides: the wrapper of an item's file, and string values that are ids.

    ``wrappers``: (source_path, wrapper_id); ``strings``: (item_id, value). Only string values that name
    the item itself are left out.
    """
    known = items.select(F.col("item_id").alias("dst"))
    wrapped = items.join(wrappers, "source_path").select(F.col("item_id").alias("src"), F.col("wrapper_id").alias("dst"))
    named = strings.where("value <> item_id").select(F.col("item_id").alias("src"), F.col("value").alias("dst")).join(known, "dst", "left_semi")
    return reference_edges(items).unionByName(wrapped).unionByName(named.select("src", "dst")).distinct()
