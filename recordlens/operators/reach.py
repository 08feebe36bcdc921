"""Reachability of many seeds: cycles contracted, then sets of components as bitmaps that all seeds share."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.operators.graph import written
from recordlens.operators.relations import indexed

#: Bits of a bitmap: those of Spark's bitmap functions.
BITS = 32_768


def _joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _trimmed(core: DataFrame) -> DataFrame:
    """The edges (src, dst) without those of nodes that nothing leads to or that lead nowhere, again and again."""
    n = core.count()
    while n:
        inside = core.select(F.col("src").alias("id")).distinct().join(core.select(F.col("dst").alias("id")).distinct(), "id")
        inside = written(inside)
        core = written(core.join(inside, F.col("src") == F.col("id"), "left_semi").join(inside, F.col("dst") == F.col("id"), "left_semi"))
        left = core.count()
        if left == n:
            break
        n = left
    return core


def _colours(core: DataFrame) -> DataFrame:
    """(id, colour): the largest id that leads to each node; a node leads to itself."""
    known = written(core.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("colour"), F.lit(True).alias("new")))
    while not known.where("new").isEmpty():
        led = core.join(known.where("new"), F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("led"))
        larger = F.coalesce(F.col("led") > F.col("colour"), F.lit(False))
        known = written(known.join(led, "id", "left").select("id", F.when(larger, F.col("led")).otherwise(F.col("colour")).alias("colour"), larger.alias("new")))
    return known.select("id", "colour")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the strongly connected component of every node of ``edges`` (src, dst), named by its smallest id.

    What is on no cycle is trimmed off. In the rest, each node takes the largest id that leads to it as its colour; what leads back to
    the node of that id within its colour is a component. Nodes of found components go, and the rest is treated again.
    Edges with a null end lead nowhere.
    """
    links = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    core, found = _trimmed(links.where("src <> dst")), []
    while not core.isEmpty():
        colours = _colours(core)
        of = lambda end: colours.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
        inner = written(core.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", F.col("dst").alias("at")))
        frontier = written(colours.where("id = colour"))
        parts = [frontier]
        while not frontier.isEmpty():
            back = inner.join(frontier.select(F.col("id").alias("at"), "colour"), "at").select(F.col("src").alias("id"), "colour").distinct()
            frontier = written(back.join(_joined(parts).select("id"), "id", "left_anti"))
            parts.append(frontier)
        members = written(_joined(parts))
        names = members.groupBy("colour").agg(F.min("id").alias("component"))
        found.append(members.join(names, "colour").select("id", "component"))
        gone = members.select("id")
        core = _trimmed(written(core.join(gone, F.col("src") == F.col("id"), "left_anti").join(gone, F.col("dst") == F.col("id"), "left_anti")))
    if not found:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(_joined(found), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _bitmaps(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, bucket, bits): what each component of an acyclic graph of numbers (src, dst) leads to, itself included.

    Components whose successors are done are done next: their sets are the unions of their successors' sets.
    """
    own = lambda some: some.groupBy("n", F.expr(f"n div {BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("n", F.lit(BITS))).alias("bits"))
    done, left, open_ = [], nodes, links
    while not left.isEmpty():
        ready = written(left.join(open_.select(F.col("src").alias("n")).distinct(), "n", "left_anti"))
        sets = own(ready)
        if done:
            known = _joined(done).withColumnRenamed("n", "dst")
            led = links.join(ready.select(F.col("n").alias("src")), "src", "left_semi").join(known, "dst").select(F.col("src").alias("n"), "bucket", "bits")
            sets = sets.unionByName(led).groupBy("n", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        done.append(written(sets))
        left = written(left.join(ready, "n", "left_anti"))
        open_ = written(open_.join(ready.select(F.col("n").alias("dst")), "dst", "left_anti"))
    return _joined(done) if done else nodes.limit(0).select("n", F.col("n").alias("bucket"), F.lit(b"").alias("bits"))


def _members(batches):
    """(n, held) for each bit of (n, bucket, bits)."""
    for b in batches:
        for n, bucket, bits in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + bucket * BITS
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at)], ["n", "held"])


class Reach:
    """What every node of ``edges`` (src, dst) leads to, written once and shared by all seeds that are asked for.

    As large as the components' sets, at a bit a component and bucket of BITS, compressed where they are written; nodes of
    one cycle have one set. Components that nothing leads to have none: theirs are their successors' sets, and no other set needs them.
    """

    def __init__(self, edges: DataFrame):
        self.nodes = written(components(edges))
        self.numbers = written(indexed(self.nodes.select("component").distinct(), ["component"], "n").select("component", F.col("n").cast("long").alias("n")))
        of = self.nodes.join(self.numbers, "component").select("id", "n")
        ends = edges.select("src", "dst").join(of.select(F.col("id").alias("src"), F.col("n").alias("s")), "src").join(of.select(F.col("id").alias("dst"), F.col("n").alias("d")), "dst")
        links = written(ends.where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
        led = links.select(F.col("dst").alias("n")).distinct()
        self.of, self.links = written(of), links
        self.sets = _bitmaps(links.join(led, F.col("src") == F.col("n"), "left_semi"), led)

    def of_seeds(self, seeds: DataFrame) -> DataFrame:
        """(seed, id): each seed of ``seeds`` (id) with all that it leads to; a seed without edges has itself."""
        asked = seeds.where("id is not null").select(F.col("id").alias("seed")).distinct()
        placed = asked.join(self.of.withColumnRenamed("id", "seed"), "seed")
        # Seeds by the set that they have, or those of their successors, and by their own component.
        roots = placed.join(self.sets.select("n").distinct(), "n", "left_anti")
        sets = placed.join(roots, ["seed", "n"], "left_anti").unionByName(roots.join(self.links, F.col("n") == F.col("src")).select("seed", F.col("dst").alias("n")))
        held = self.sets.join(sets.select("n").distinct(), "n", "left_semi").mapInArrow(_members, "n long, held long")
        reached = sets.join(held, "n").select("seed", F.col("held").alias("n")).unionByName(roots.select("seed", "n"))
        reached = reached.join(self.of, "n").select("seed", "id")
        return reached.unionByName(asked.select("seed", F.col("seed").alias("id"))).distinct()
