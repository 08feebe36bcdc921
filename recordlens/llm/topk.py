"""Exact top-k inner-product search by distributed histogram selection (operator 10).

Every vector is scored against a block of queries, and only counts leave the tasks: per query a
histogram of the scores, cut below the task's own k-th value, which cannot exceed the overall one. The
histograms are summed and searched for the bin of the k-th highest score by Spark; the next round splits that
bin alone, until bins are one integer wide and the k-th value is known. The last pass keeps the scores that reach
it, at most k a query and task, and ties fall to the smaller vec_id. Only the bounds of the queries under way,
QUERY_BLOCK of them, pass through the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut, shared_dir

#: Queries that are sent to the tasks at once, and that many vectors are scored against them at once.
QUERY_BLOCK = 16384
ROW_BLOCK = 128
BINS = 512


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component; rows that take no part are left out."""
    parts = F.col("embedding").cast("array<double>")
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(sound)
        .select("vec_id", F.transform(parts, lambda x: _floor(x * scale)).alias("q"))
    )


def _floor(x):
    """The floor as a double; numbers too large for a fraction are their own."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _matrices(batch):
    """(ids, matrix) for each length of vector in a batch, in blocks of rows."""
    ids, lists = np.asarray(batch.column(0)), batch.column(1)
    ends = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)
    size = np.diff(ends)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for at in range(0, len(rows), ROW_BLOCK):
            some = rows[at : at + ROW_BLOCK]
            yield ids[some], flat[ends[some][:, None] + np.arange(n)]


def _scores(batches, block):
    """(ids of vectors, queries' numbers, scores) with minus infinity at a query's own id."""
    for b in batches:
        for ids, m in _matrices(b):
            if m.shape[1] in block:
                nth, qids, q = block[m.shape[1]]
                s = m @ q.T
                s[ids[:, None] == qids[None, :]] = -np.inf
                yield ids, nth, s


def _histogram(block, low, high, width, queries, k):
    """Counts by bin of each query's scores from low to under high, from the top down to where k are reached."""

    def run(batches):
        counts = np.zeros((queries, BINS), np.int64)
        for _, nth, s in _scores(batches, block.value):
            bins = np.floor((s - low[nth]) / width[nth])
            ok = (bins >= 0) & (bins < BINS) & (s < high[nth])
            at = (bins + nth * BINS)[ok].astype(np.int64)
            counts += np.bincount(at, minlength=queries * BINS).reshape(queries, BINS)
        from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        q, b = np.nonzero((counts > 0) & (from_top - counts < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["q", "bin", "n"])

    return run


def _best(q, ids, s, k):
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], s[keep]


def _reached(block, least, k):
    """The scores that reach ``least``, at most the k best of a query."""

    def run(batches):
        q, ids, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for vid, nth, score in _scores(batches, block.value):
            r, c = np.nonzero((score >= least[nth]) & (score > -np.inf))
            q, ids, s = _best(np.concatenate([q, nth[c]]), np.concatenate([ids, vid[r]]), np.concatenate([s, score[r, c]]), k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(s.astype(np.int64))], ["q", "vec_id", "score"])

    return run


def _block_topk(vectors: DataFrame, ids: np.ndarray, queries: list, norm: float, k: int) -> DataFrame:
    n = len(ids)
    sizes = np.array([len(v) for v in queries])
    by_size = {}
    for d in np.unique(sizes):
        nth = np.flatnonzero(sizes == d)
        by_size[int(d)] = (nth, ids[nth], np.array([queries[i] for i in nth], np.float64).reshape(len(nth), d))
    block = vectors.sparkSession.sparkContext.broadcast(by_size)
    reach = np.array([np.ceil(np.sqrt(np.dot(v, v)) * norm) + 1 for v in map(np.asarray, queries)])
    low, high, wanted = -reach, np.full(n, np.inf), np.full(n, k)
    width = np.maximum(1.0, np.ceil((2 * reach + 1) / BINS))
    least = np.full(n, -np.inf)
    open_ = np.ones(n, bool)
    spark = vectors.sparkSession
    from_top = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    while open_.any():
        counted = vectors.mapInArrow(_histogram(block, low, high, width, n, k), "q long, bin long, n long")
        sums = counted.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("above", F.sum("n").over(from_top))
        state = spark.createDataFrame(pd.DataFrame({"q": np.flatnonzero(open_), "wanted": wanted[open_]}))
        hit = sums.join(F.broadcast(state), "q").where("above >= wanted and above - n < wanted").select("q", "bin", "n", "above").toPandas()
        # Queries without such a bin have fewer candidates than k: all of them are wanted.
        i, at = hit["q"].to_numpy(np.int64), hit["bin"].to_numpy(np.int64)
        open_[:] = False
        open_[i] = width[i] > 1
        wanted[i] -= hit["above"].to_numpy(np.int64) - hit["n"].to_numpy(np.int64)
        low[i] += at * width[i]
        least[i], high[i] = low[i], low[i] + width[i]
        width[i] = np.maximum(1.0, np.ceil(width[i] / BINS))
    kept = vectors.mapInArrow(_reached(block, least, k), "q long, vec_id long, score long")
    names = spark.createDataFrame(pd.DataFrame({"q": np.arange(n), "query_id": ids}))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")


def topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The ``k`` best vectors of each query among ``vectors`` (vec_id, embedding; others are ignored).

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another
    vec_id and as many components. Returns query_id, rank (from 1), vec_id and score (a long). Rows with
    a null vec_id, a null vector, or null, NaN or infinite components take no part. Ties go to the
    smaller vec_id; rows that repeat a vec_id are candidates as often as they come, and a query that is
    repeated with the same vector is answered once. Fewer than k candidates are all returned; none give
    no rows. Scores are exact up to 2**53. The queries are sent in blocks of QUERY_BLOCK vectors, so what is
    broadcast does not grow; the answers of a block are added to one written table.
    """
    whole = cut(quantise(vectors, scale))
    asked = cut(whole.where(F.col("vec_id") % every == 0).distinct())
    total = asked.count()
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    norm = whole.agg(F.max(F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
    blocks = -(-total // QUERY_BLOCK)
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(at)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id", "q").collect()
        for i in range(0, len(rows), QUERY_BLOCK):
            some = rows[i : i + QUERY_BLOCK]
            found = _block_topk(whole, np.array([r[0] for r in some], np.int64), [r[1] for r in some], norm, k)
            found.write.mode("append").parquet(at)
    return spark.read.schema(schema).parquet(at)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
