"""Peak concurrency of open intervals by group, swept in chunks of time (operator 12).

Starts and ends become deltas, added up by group and second, so a group's chunk of 2**CHUNK_BITS seconds has at most that
many rows however hot the group is. What a chunk needs from the time before it (what is open, the highest so far, the
next moment after it) comes from a scan over the chunks' totals. The scan itself has levels: FAN chunks make a wider
one, and so on up to three levels, which span all timestamps there are, so no window sees more than FAN rows of a
group. Each chunk's carries and its deltas meet in one grouped Arrow task, where DuckDB runs the window functions.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut

#: Seconds of a chunk, and how many chunks a wider one has, as powers of two.
CHUNK_BITS = 16
FAN_BITS = 10
#: Chunks of 2**36 seconds, over two thousand years, are the widest; a timestamp's range has a few of them.
LEVELS = 2
DAY = 86_400
#: The group that holds everything, and that of what has no group.
ALL, NONE = -2, -1


def seconds(df: DataFrame, column: str):
    """UTC seconds since 1970, rounded down; times without a zone are UTC."""
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_seconds(column)
    at = F.col(column)
    return F.unix_date(at.cast("date")).cast("long") * DAY + F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at))


def cents(total):
    """floor(100 * total + 0.5); nulls and what is no 64-bit number count nothing."""
    value = F.floor(F.coalesce(total, F.lit(0.0)).cast("double") * 100 + 0.5)
    sound = F.abs(F.coalesce(total, F.lit(0.0)).cast("double")) < 9e16
    return F.when(sound, value.cast("long")).otherwise(F.lit(0).cast("long"))


def intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 1) -> DataFrame:
    """(nation_id, start, end, cents) of the sales that are open at all; a null end is never.

    Both joins have exchanges of their own on either side, so that adaptive execution splits hot sales and
    clients; neither broadcasts.
    """
    first = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.min(seconds(lines, "shipped_at")).alias("shipped"))
    ends = cut(first.select(F.col("sale_id").cast("long").alias("sale_id"), (F.col("shipped") + days * DAY).alias("end")))
    nations = cut(
        clients.where("client_id is not null and nation_id is not null")
        .groupBy(F.col("client_id").cast("long").alias("client_id"))
        .agg(F.min(F.col("nation_id").cast("int")).alias("nation_id"))
    )
    sold = sales.where("sold_at is not null").select(
        F.col("sale_id").cast("long").alias("sale_id"), F.col("client_id").cast("long").alias("client_id"), seconds(sales, "sold_at").alias("start"), cents(F.col("total")).alias("cents")
    )
    open_ = sold.join(ends.hint("merge"), "sale_id", "left").where("end is null or end > start")
    named = open_.select("client_id", "start", "end", "cents").join(nations.hint("merge"), "client_id", "left")
    return named.select(F.coalesce("nation_id", F.lit(NONE)).alias("nation_id"), "start", "end", "cents")


def deltas(spans: DataFrame) -> DataFrame:
    """(nation_id, chunk, t, dn, dc): what changes at a second in a nation, and in all; seconds without change are left out."""
    moves = F.array(
        F.struct(F.col("start").alias("t"), F.lit(1).cast("long").alias("dn"), F.col("cents").alias("dc")),
        F.struct(F.col("end").alias("t"), F.lit(-1).cast("long").alias("dn"), (-F.col("cents")).alias("dc")),
    )
    added = [F.sum("dn").alias("dn"), F.sum("dc").alias("dc")]
    own = spans.select("nation_id", F.inline(moves)).where("t is not null").groupBy("nation_id", "t").agg(*added)
    both = own.select(F.explode(F.array("nation_id", F.lit(ALL))).alias("nation_id"), "t", "dn", "dc").groupBy("nation_id", "t").agg(*added)
    return both.where("dn <> 0 or dc <> 0").withColumn("chunk", F.shiftright("t", CHUNK_BITS))


def chunk_totals(moves: DataFrame) -> DataFrame:
    """Per nation and chunk: its first moment, its sums, and how high its running sums come above where they start."""
    w = Window.partitionBy("nation_id", "chunk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    running = moves.withColumn("n", F.sum("dn").over(w)).withColumn("c", F.sum("dc").over(w))
    return running.groupBy("nation_id", "chunk").agg(
        F.min("t").alias("first_s"), F.sum("dn").alias("dn"), F.sum("dc").alias("dc"), F.max("n").alias("top_n"), F.max("c").alias("top_c")
    )


def carries(totals: DataFrame) -> DataFrame:
    """What each chunk starts from: n, c, high (null: nothing before), next_s (null: nothing after) and the nation's peak_c."""
    levels, level = [], totals
    for depth in range(LEVELS + 1):
        keys = ["nation_id"] if depth == LEVELS else ["nation_id", "wider"]
        level = level.withColumn("wider", F.shiftright("chunk", FAN_BITS))
        before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumns({"n": F.coalesce(F.sum("dn").over(before), F.lit(0)), "c": F.coalesce(F.sum("dc").over(before), F.lit(0))})
        level = level.withColumns({"high": F.max(F.col("n") + F.col("top_n")).over(before), "next_s": F.lead("first_s").over(Window.partitionBy(*keys).orderBy("chunk"))})
        levels.append(level)
        level = level.groupBy("nation_id", F.col("wider").alias("chunk")).agg(
            F.min("first_s").alias("first_s"), F.sum("dn").alias("dn"), F.sum("dc").alias("dc"),
            F.max(F.col("n") + F.col("top_n")).alias("top_n"), F.max(F.col("c") + F.col("top_c")).alias("top_c"),
        )
    peak = F.max(F.col("c") + F.col("top_c")).over(Window.partitionBy("nation_id"))
    known = levels.pop().select("nation_id", "chunk", "n", "c", "high", "next_s", peak.alias("peak_c"))
    while levels:
        above = known.select("nation_id", F.col("chunk").alias("wider"), *(F.col(x).alias(f"{x}_") for x in ("n", "c", "high", "next_s")), "peak_c")
        known = levels.pop().join(above.hint("merge"), ["nation_id", "wider"]).select(
            "nation_id", "chunk", (F.col("n") + F.col("n_")).alias("n"), (F.col("c") + F.col("c_")).alias("c"),
            F.greatest(F.col("high_"), F.col("high") + F.col("n_")).alias("high"), F.coalesce("next_s", "next_s_").alias("next_s"), "peak_c",
        )
    return known


_SWEEP = """
SELECT $nation AS nation_id, t AS from_s, lead(t, 1, $next) OVER w AS to_s, n_open, open_cents,
  greatest(max(n_open) OVER w, $high) AS high_open, open_cents = $peak AS is_peak
FROM (SELECT t, ($n + sum(dn) OVER w)::BIGINT AS n_open, ($c + sum(dc) OVER w)::BIGINT AS open_cents FROM deltas WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING))
WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)
"""
_OUT = pa.schema([("nation_id", pa.int32()), ("from_s", pa.int64()), ("to_s", pa.int64()), ("n_open", pa.int64()), ("open_cents", pa.int64()), ("high_open", pa.int64()), ("is_peak", pa.bool_())])


@cache
def _duck():
    """The worker's own in-memory DuckDB, on one thread and without files."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})


def sweep(key, moves: pa.Table, carry: pa.Table) -> pa.Table:
    """The rows of one nation's chunk from its deltas and the one row of its carries."""
    before = carry.to_pylist()[0]
    con = _duck()
    con.register("deltas", moves.select(["t", "dn", "dc"]))
    try:
        given = {"nation": key[0].as_py(), "next": before["next_s"], "high": before["high"], "peak": before["peak_c"], "n": before["n"], "c": before["c"]}
        return con.sql(_SWEEP, params=given).to_arrow_table().cast(_OUT)
    finally:
        con.unregister("deltas")


def concurrency(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 1) -> DataFrame:
    """How many sales, and of what value, are open in a nation from each moment that changes it.

    A sale is open from its second of sold_at until ``days`` days after the earliest shipped_at of its lines, forever
    if there is none (so too for a null sale_id). It counts for its client's nation (-1: null client or nation, or no such
    client; the smallest nation where a client_id repeats) and for nation -2. A null total, and one that is no number or whose
    cents pass 64 bits, is worth nothing. Repeated sales count as often as they come. Null sold_at and sales that end when or
    before they start take no part. Times without a zone are UTC. Other columns are ignored; no sales give no rows. Returns
    nation_id, from_s, to_s, n_open, open_cents, high_open and is_peak.
    """
    moves = cut(deltas(intervals(sales, lines, clients, days)))
    known = cut(carries(cut(chunk_totals(moves))))
    by, tasks = ("nation_id", "chunk"), int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "nation_id int, from_s long, to_s long, n_open long, open_cents long, high_open long, is_peak boolean"
    # Chunks cost time rather than bytes, so they are dealt out by number, which adaptive execution leaves as it is.
    dealt = [x.repartition(tasks, *by).groupBy(*by) for x in (moves, known)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(sweep, schema)


ORACLE_SQL = """
WITH ends AS (
  SELECT sale_id, floor(epoch(min(shipped_at)))::BIGINT + 86400 AS e FROM sale_lines WHERE shipped_at IS NOT NULL GROUP BY sale_id
), nations AS (
  SELECT client_id, min(nation_id) AS nation_id FROM clients WHERE client_id IS NOT NULL GROUP BY client_id
), spans AS (
  SELECT coalesce(nation_id, -1) AS nation_id, floor(epoch(sold_at))::BIGINT AS s, e, coalesce(floor(100 * total + 0.5), 0)::BIGINT AS c
  FROM sales LEFT JOIN ends USING (sale_id) LEFT JOIN nations USING (client_id)
  WHERE sold_at IS NOT NULL AND (e IS NULL OR e > floor(epoch(sold_at))::BIGINT)
), both_ AS (
  SELECT * FROM spans UNION ALL SELECT -2, s, e, c FROM spans
), moves AS (
  SELECT nation_id, t, sum(dn) AS dn, sum(dc) AS dc FROM (
    SELECT nation_id, s AS t, 1 AS dn, c AS dc FROM both_ UNION ALL SELECT nation_id, e, -1, -c FROM both_ WHERE e IS NOT NULL)
  GROUP BY nation_id, t HAVING sum(dn) <> 0 OR sum(dc) <> 0
), swept AS (
  SELECT nation_id, t, lead(t) OVER w AS to_s, (sum(dn) OVER w)::BIGINT AS n_open, (sum(dc) OVER w)::BIGINT AS open_cents
  FROM moves WINDOW w AS (PARTITION BY nation_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT nation_id::INTEGER AS nation_id, t AS from_s, to_s, n_open, open_cents,
  max(n_open) OVER (PARTITION BY nation_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high_open,
  open_cents = max(open_cents) OVER (PARTITION BY nation_id) AS is_peak
FROM swept
"""
