"""Sharding by jump consistent hashing (operator 4), in DataFrame functions only.

A key walks the published sequence of jumps of the 64-bit congruential generator until it would leave
the shards that there are; no ring or table is kept. With one shard more a key either stays or goes to
the new shard. Slots number the rows of a shard gaplessly in the order of doc_id without gathering a
shard in one task: rows are ranged by doc_id, counted per range and shard, and numbered within both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_63 = 9223372036854775808

#: Rows of a range of doc_ids, about; a shard's share of it is numbered in one task.
ROWS_PER_RANGE = 200_000


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 as a signed long; decimals do not overflow under ANSI rules."""
    product = key.cast("decimal(19,0)") * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    low = F.pmod(product, F.lit(str(TWO_64)).cast("decimal(20,0)"))
    return F.when(low >= F.lit(str(TWO_63)).cast("decimal(20,0)"), low - F.lit(str(TWO_64)).cast("decimal(20,0)")).otherwise(low).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a long ``key`` among ``shards``."""

    def step(state: Column, _: Column) -> Column:
        key = _next_key(state["key"])
        ahead = (state["at"] + 1) * (F.lit(2.0**31) / (F.shiftrightunsigned(key, 33) + 1).cast("double"))
        moved = F.struct(key.alias("key"), state["at"].alias("shard"), F.floor(ahead).cast("long").alias("at"))
        return F.when(state["at"] < shards, moved).otherwise(state)

    start = F.struct(key.cast("long").alias("key"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"].cast("int"))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) with its shard and slot.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law (``key``), shard, slot and
    grown_shard, the shard with one shard more. A null text has no bytes (size 8, crc 0). A null doc_id
    counts as the key 0 and comes first in its shard. Rows of one doc_id share a shard and get slots of
    their own, ordered by size and crc; which of two equal rows comes first makes no difference. No rows
    give no rows.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    key = F.coalesce(doc, F.lit(0).cast("long"))
    narrow = cut(
        docs.select(
            doc.alias("doc_id"),
            (F.octet_length(data).cast("long") + 8).alias("size"),
            F.crc32(data).alias("text_crc32"),
            jump_shard(key, shards).alias("shard"),
            jump_shard(key, shards + 1).alias("grown_shard"),
        )
    )
    ranges = max(1, -(-narrow.count() // ROWS_PER_RANGE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(narrow.repartitionByRange(ranges, "doc_id", "size", "text_crc32").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard"), F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = ranged.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"), "grown_shard"
    )


def _walk_sql(shards: int) -> str:
    step = (
        f"{{'k': (p.k * {MULTIPLIER} + 1) % {TWO_64}, 'b': p.j, 'j': floor((p.j + 1) * (2147483648.0::DOUBLE / "
        f"((((p.k * {MULTIPLIER} + 1) % {TWO_64}) // 8589934592) + 1)::DOUBLE))::BIGINT}}"
    )
    start = "{'k': k, 'b': -1::BIGINT, 'j': 0::BIGINT}"
    return f"list_reduce([{', '.join([start] * (shards + 1))}], lambda p, z: CASE WHEN p.j < {shards} THEN {step} ELSE p END).b"


#: The same in SQL: the walk as a fold, and the checksum as a fold over the bytes.
ORACLE_SQL = f"""
WITH bits AS (
  SELECT i, list_reduce([i] || list_transform(range(8), lambda z: z::BIGINT),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256))::BIGINT AS i)
), tbl AS (
  SELECT list(c ORDER BY i) AS t FROM bits
), d AS (
  SELECT doc_id, coalesce(text, '') AS s, ((coalesce(doc_id, 0)::HUGEINT % {TWO_64}) + {TWO_64}) % {TWO_64} AS k FROM documents
), walked AS (
  SELECT doc_id, s, hex(encode(s)) AS x, {_walk_sql(24)} AS shard, {_walk_sql(25)} AS grown_shard FROM d
), summed AS (
  SELECT doc_id, strlen(s)::BIGINT + 8 AS size, shard, grown_shard,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM walked, tbl
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM summed
"""
