"""Referential, duplicate, contract and order checks, upserts and set comparisons over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.operators.graph import written


def findings(rows: DataFrame, code: str, path: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), path.cast("string").alias("path"), message.cast("string").alias("message"))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is set and has no parent. A null key is a matter of another rule."""
    keys = parent.select(F.col(parent_key).alias("__key"))
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__key"), "left_anti")


def resolved(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def reference_report(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check_name, violations) for (name, child, key, parent, parent key) rows."""
    return reduce(
        DataFrame.unionByName,
        [dangling(c, k, p, pk).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations") for name, c, k, p, pk in checks],
    )


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, first): keys that occur more than once, and the first place."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with is_later: true for all but the first of a key by ``order``.

    A minimum per key joined back, not a window: a key with a third of the rows is pre-aggregated and
    the join can split it.
    """
    least = rows.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    joined = rows.join(least, F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn("is_later", F.col(order) > F.col("__first")).drop("__key", "__first")


def collisions(rows: DataFrame, token: str, owner: str) -> DataFrame:
    """Rows whose token belongs to another owner, the smallest one; a repeat by the same owner is fine."""
    first = rows.groupBy(F.col(token).alias("__token")).agg(F.min(owner).alias("first_owner"))
    return rows.join(first, F.col(token) == F.col("__token")).where(F.col(owner) != F.col("first_owner")).drop("__token")


def contract(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected_n, actual_n, status): the one-to-one contract of cases and responses."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("expected_n"))
    a = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual_n"))
    zero = F.lit(0).cast("long")
    both = e.join(a, key, "full_outer").select(key, F.coalesce("expected_n", zero).alias("expected_n"), F.coalesce("actual_n", zero).alias("actual_n"))
    status = (
        F.when(F.col("expected_n") == 0, "unknown")
        .when(F.col("actual_n") == 0, "missing")
        .when((F.col("expected_n") > 1) | (F.col("actual_n") > 1), "duplicate")
        .otherwise("matched")
    )
    return both.withColumn("status", status)


def require_contract(expected: DataFrame, actual: DataFrame, key: str) -> None:
    """Refuse a run that lacks, repeats or invents cases."""
    bad = contract(expected, actual, key).where("status <> 'matched'").groupBy("status").count().collect()
    if bad:
        raise ValueError("; ".join(sorted(f"{r['count']} {r['status']}" for r in bad)))


def upsert(base: DataFrame, update: DataFrame, key: str, allow_create: bool = True, ordinal: str | None = None) -> DataFrame:
    """``base`` with the rows of ``update`` in the place of those with their key; new ones are added.

    Refuses an update that repeats a key or, unless allowed, creates one. Keys must not be null. With ``ordinal``, a
    column of ``base`` alone, a row that is replaced keeps its place and new ones follow the last by their keys.
    """
    if not update.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"the update repeats a {key}")
    if not allow_create and not dangling(update, key, base, key).isEmpty():
        raise ValueError(f"the update creates a {key}")
    kept = base.join(update.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    if ordinal is None:
        return kept.unionByName(update.select(*base.columns))
    last = base.agg(F.coalesce(F.max(ordinal), F.lit(-1))).first()[0]
    known = update.join(base.select(F.col(key).alias("__key"), ordinal), F.col(key) == F.col("__key")).drop("__key")
    new = indexed(update.join(base.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti"), [key], ordinal)
    new = new.withColumn(ordinal, (F.col(ordinal) + last + 1).cast(base.schema[ordinal].dataType))
    return kept.unionByName(known.select(*base.columns)).unionByName(new.select(*base.columns))


def fileset_difference(declared: DataFrame, actual: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, status): missing, unexpected or changed files."""
    d = declared.select(F.col(path).alias("path"), F.col(digest).alias("__d"), F.lit(True).alias("__declared"))
    a = actual.select(F.col(path).alias("path"), F.col(digest).alias("__a"), F.lit(True).alias("__actual"))
    status = F.when(F.col("__actual").isNull(), "missing").when(F.col("__declared").isNull(), "unexpected").when(~F.col("__d").eqNullSafe(F.col("__a")), "changed")
    return d.join(a, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def set_relations(left: Column, right: Column) -> Column:
    """Array comparisons side by side; the three notions of agreement are not the same."""
    return F.struct(
        F.arrays_overlap(left, right).alias("overlap"),
        (F.size(F.array_except(left, right)) == 0).alias("left_is_subset"),
        F.array_sort(F.array_distinct(left)).eqNullSafe(F.array_sort(F.array_distinct(right))).alias("same_set"),
        F.array_sort(left).eqNullSafe(F.array_sort(right)).alias("same_multiset"),
    )


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def order_violations(rows: DataFrame, by: list[str], order: str, instant: str, ranges: int | None = None) -> DataFrame:
    """Rows earlier than the last row before them with an instant; rows without one are passed over.

    ``by``: keys of independent streams; equal places of ``order`` come in any order. Streams are cut into ``ranges``, so a long one is many
    windows: each gives its last instant, which is carried on to the first rows of the next range. What is brought together for a
    stream is a row a range.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *by, order).withColumn("__range", F.spark_partition_id()))
    last = F.max_by(instant, F.when(F.col(instant).isNotNull(), F.struct(order, instant)))
    ends = ranged.groupBy("__range", *by).agg(last.alias("__last"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__range", *by, F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    before = Window.partitionBy("__range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = ranged.withColumn("__own", F.last(instant, ignorenulls=True).over(before)).where(F.col(instant).isNotNull())
    same = [marked[c].eqNullSafe(carried[c]) for c in ("__range", *by)]
    joined = marked.join(carried.where("__carried is not null"), reduce(Column.__and__, same), "left")
    found = joined.select(*(marked[c] for c in rows.columns), F.coalesce("__own", "__carried").alias("previous"))
    return found.where(F.col(instant) < F.col("previous"))


def adjacent_to(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """Rows without the flag in a group that holds a row with it."""
    marked = rows.withColumn("__flag", flag)
    groups = marked.where("__flag").select(F.col(by).alias("__by")).distinct()
    return marked.where(~F.coalesce("__flag", F.lit(False))).join(groups, F.col(by) == F.col("__by"), "left_semi").drop("__flag")


def zero_filled(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """(column, n) for every word of the vocabulary, those that do not occur too."""
    words = rows.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def progressive_match(child: DataFrame, parent: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """Per key: whether some parent meets the first condition, the first two, and so on."""
    joined = child.join(parent, key, "left")
    so_far, columns = F.lit(True), []
    for name, condition in conditions.items():
        so_far = so_far & F.coalesce(condition, F.lit(False))
        columns.append(F.max(so_far).alias(name))
    return joined.groupBy(key).agg(*columns)


def indexed(rows: DataFrame, order: list[str], name: str = "vector_index", buckets: int | None = None) -> DataFrame:
    """A dense index, from 0, over the order of ``order``, without gathering all rows in one task.

    Rows are ranged, counted per range, and numbered within.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__nth", nth).join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__nth")).drop("__part", "__nth", "__n", "__base")
