"""Greedy selection under a token budget, with and without dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.operators.graph import closure_by_seed, written

# The order of sections, by kind, among items of one priority.
SECTION_ORDER = {
    "wrapper": 0,
    "identity": 1,
    "organization": 1,
    "term": 2,
    "claim": 3,
    "project": 4,
    "publication": 5,
    "research_topic": 6,
    "relationship": 7,
    "event": 8,
    "source": 9,
}


def section_rank(kind: Column) -> Column:
    """The place of a kind's section, 99 for an unknown one."""
    ranks = F.create_map(*(F.lit(x) for pair in SECTION_ORDER.items() for x in pair))
    return F.coalesce(F.try_element_at(ranks, kind), F.lit(99))


def greedy_pack(items: DataFrame, by: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """The rows of ``items`` that are taken, per group: in order, each that still fits; one that doesn't is passed over.

    Costs are whole and not negative; null costs and null groups are never taken. Room only shrinks, so
    what doesn't fit now never will. A round takes the longest run that fits, passes over the row that
    ended it, and goes on behind it with what fits the room left. A round looks at ``budget`` rows of a
    group at most, as every row costs something; rows that cost nothing are all taken.
    """
    rows = written(items.where(F.col(cost).isNotNull() & F.col(by).isNotNull()).withColumn("__at", F.struct(*order)))
    taken = [rows.where(F.col(cost) == 0)]
    rest = rows.where(F.col(cost) > 0)
    state = rest.select(by).distinct().select(F.col(by).alias("__by"), F.lit(budget).cast("long").alias("__room"), F.lit(None).cast(rows.schema["__at"].dataType).alias("__last"))
    group = Window.partitionBy(by).orderBy("__at")
    while True:
        fits = (F.col(cost) <= F.col("__room")) & (F.col("__last").isNull() | (F.col("__at") > F.col("__last")))
        seen = rest.join(state, F.col(by) == F.col("__by")).where(fits).withColumn("__nth", F.row_number().over(group)).where(F.col("__nth") <= budget)
        seen = written(seen.withColumn("__sum", F.sum(cost).over(group.rowsBetween(Window.unboundedPreceding, 0))))
        ok = F.col("__sum") <= F.col("__room")
        taken.append(seen.where(ok).select(*rows.columns))
        state = written(
            seen.groupBy(F.col(by).alias("__by"))
            .agg(
                (F.max("__room") - F.coalesce(F.max(F.when(ok, F.col("__sum"))), F.lit(0))).alias("__room"),
                F.min(F.when(~ok, F.col("__at"))).alias("__last"),
            )
            .where("__last is not null and __room > 0")
        )
        if state.isEmpty():
            return reduce(DataFrame.unionByName, taken).drop("__at")


#: Items of a profile that a round of the selection looks at.
LOOK = 10_000


def _round(needs: DataFrame, taken: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round for every profile of ``state`` (profile, room, last): what is taken now, and the state after it.

    Prices are what a closure adds to what is taken. An item that costs more than the room can't come in later, as
    what is taken on the way lowers both alike. Of the others the first LOOK are looked at in order. As long as what they
    add does not overlap, their prices hold whatever is taken before, so all go in up to the first that shares an
    addition with an earlier one, which the next round looks at again, or that no longer fits, which is passed over.
    """
    open_ = needs.join(F.broadcast(state)).where("last is null or at > last").join(taken, ["profile", "id"], "left_anti")
    priced = open_.groupBy("profile", "at", "room").agg(F.sum("cost").alias("price")).where("price <= room")
    order = Window.partitionBy("profile").orderBy("at")
    seen = priced.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LOOK)
    seen = written(seen.withColumn("sum", F.sum("price").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    adds = open_.select("profile", "at", "id").join(seen.select("profile", "at", "nth"), ["profile", "at"])
    first = adds.groupBy("profile", "id").agg(F.min("nth").alias("first"))
    clash = adds.join(first, ["profile", "id"]).where("nth > first").groupBy("profile").agg(F.min("nth").alias("clash"))
    full = seen.where("sum > room").groupBy("profile").agg(F.min("nth").alias("full"))
    never = F.lit(LOOK + 1)
    ends = seen.groupBy("profile").agg(F.max("nth").alias("most")).join(clash, "profile", "left").join(full, "profile", "left")
    ends = written(ends.select("profile", "most", F.coalesce("clash", never).alias("clash"), F.coalesce("full", never).alias("full"))).withColumn("stop", F.least("clash", "full"))
    got = written(adds.join(F.broadcast(ends), "profile").where("nth < stop").select("profile", "id").distinct())
    # The last item settled: the one that no longer fits, or else the one before the clash.
    settled = F.when(F.col("full") < F.col("clash"), F.col("full")).otherwise(F.least(F.col("clash") - 1, "most"))
    known = seen.join(F.broadcast(ends), "profile")
    rooms = known.groupBy("profile").agg(
        (F.max("room") - F.coalesce(F.max(F.when(F.col("nth") < F.col("stop"), F.col("sum"))), F.lit(0))).alias("room"),
        F.max(F.when(F.col("nth") == settled, F.col("at"))).alias("last"),
        F.first(F.least("clash", "full") <= F.col("most")).alias("more"),
        F.max("nth").alias("most"),
    )
    return got, rooms.where(F.col("more") | (F.col("most") == LOOK)).select("profile", "room", "last")


def select_with_dependencies(items: DataFrame, edges: DataFrame, profiles: dict[str, int], fixed_cost: int = 0, everything: str = "FULL") -> DataFrame:
    """(profile, item_id): items taken with all that they depend on, in the order of priority, section, path and id.

    ``items``: (item_id, kind, priority, source_path, cost); ``edges``: (src, dst). An item whose closure does
    not fit is passed over and may come in later with another. The profile ``everything`` takes all or
    refuses. A dependency that is no item is refused; so are null costs and ones below zero. item_id is a key.

    Items are taken in rounds (see ``_round``), each for all profiles at once; the state between them is a row a profile. What is
    taken is as large as the budgets at most, but for items that cost nothing.
    """
    if not items.where("cost is null or cost < 0").isEmpty():
        raise ValueError("costs are whole and not negative")
    unknown = edges.join(items.select(F.col("item_id").alias("dst")), "dst", "left_anti")
    if not unknown.isEmpty():
        raise ValueError(f"dependency cannot be resolved: {unknown.first()['dst']}")
    spark, out = items.sparkSession, []
    if everything in profiles:
        total, room = items.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0], profiles[everything] - fixed_cost
        if total > room:
            raise ValueError(f"{everything} needs {total + fixed_cost} tokens, above {room + fixed_cost}")
        out.append(items.select(F.lit(everything).alias("profile"), "item_id"))
    rooms = [(name, int(budget) - fixed_cost) for name, budget in profiles.items() if name != everything]
    at = F.struct("priority", section_rank(F.col("kind")).alias("section"), "source_path", "item_id")
    placed = items.select(F.col("item_id").alias("seed"), at.alias("at"))
    costs = items.select(F.col("item_id").alias("id"), F.col("cost").cast("long").alias("cost"))
    closures = closure_by_seed(items.select(F.col("item_id").alias("id")), edges)
    needs = written(closures.join(costs, "id").join(placed, "seed").select("at", "id", "cost"))
    state = spark.createDataFrame(rooms, "profile string, room long").withColumn("last", F.lit(None).cast(needs.schema["at"].dataType))
    taken = written(placed.select(F.lit("").alias("profile"), F.col("seed").alias("id")).limit(0))
    while not state.isEmpty():
        got, state = _round(needs, taken, state)
        taken, state = written(taken.unionByName(got)), written(state)
    return reduce(DataFrame.unionByName, [*out, taken.select("profile", F.col("id").alias("item_id"))])
