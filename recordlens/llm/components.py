"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordlens.llm.common import cut, drop_cut


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """``e`` cut, and what tells whether it has changed, gathered while it is written."""
    seen = Observation()
    figures = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("a"), F.bit_xor(F.xxhash64("v", "u")).alias("b"))
    out = cut(e.observe(seen, *figures))
    got = seen.get
    return out, (got["n"], got["a"], got["b"])


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node that it knows."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them. Needs u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u and v, not null. Returns (u, v): node and the smallest node of its component.

    Nodes that are the smallest of theirs are left out. The rounds stop when the edges are stars and
    no longer change; each round's edges are cut to the shared folder and the round before is deleted.
    No edges give an empty table. Rows are joined by node, so a large hub is split by the skew join.
    """
    now, mark = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        then, new = _written(_small_star(_large_star(now)))
        drop_cut(now)
        now = then
        if new == mark:
            break
        mark = new
    return now
