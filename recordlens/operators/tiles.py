"""Vector top-k over tiles, blocks of vectors against blocks of queries, as the keys of one plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.operators.graph import written

#: Vectors and queries of a tile, and how many of them are multiplied at a time.
VECTORS, QUERIES = 1 << 16, 1 << 13
ROWS, COLUMNS = 4096, 512


def _blocks(rows: DataFrame, size: int, block: str) -> tuple[DataFrame, int]:
    """``rows`` (id, v) that can be scored, with their norms, in ``block``s of about ``size`` rows of falling norm; and how many.

    Rows of one norm are told apart by a hash, so no block is larger because norms are equal.
    """
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)) & (F.size("v") > 0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    normed = written(rows.where(sound & F.col("id").isNotNull()).withColumn("norm", norm))
    parts = max(1, -(-normed.count() // size))
    if parts > 1:
        normed = normed.repartitionByRange(parts, F.desc("norm"), F.xxhash64("id", "v"))
        return written(normed.withColumn(block, F.spark_partition_id())), parts
    return normed.withColumn(block, F.lit(0)), parts


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length: the rows' numbers and their matrix."""
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(ends)
    return {int(n): (at := np.flatnonzero(sizes == n), flat[ends[at][:, None] + np.arange(n)]) for n in np.unique(sizes)}


def _best(scores: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each column; of equal scores the smaller ranks."""
    n = scores.shape[0]
    if n <= k:
        c, r = np.divmod(np.arange(scores.size), n)
        return r, c
    least = np.partition(scores, n - k, axis=0)[n - k]
    r, c = np.nonzero(scores >= least)
    order = np.lexsort((ranks[r], -scores[r, c], c))
    r, c = r[order], c[order]
    keep = np.arange(len(c)) - np.searchsorted(c, c) < k
    return r[keep], c[keep]


def _tile(k: int):
    """The k best of a tile's vectors for each of its queries."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked, out = vectors.column("id"), queries.column("id"), []
        names = ids.to_pandas().to_numpy()
        ranks = np.argsort(np.argsort(names, kind="stable"), kind="stable")
        own = queries.column("id").to_pandas().to_numpy()
        some = _matrices(queries)
        for n, (rows, m) in _matrices(vectors).items():
            nth, q = some.get(n, ((), None))
            for c in range(0, len(nth), COLUMNS):
                held = [np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0)]
                columns = nth[c : c + COLUMNS]
                for r in range(0, len(rows), ROWS):
                    scores = np.einsum("nd,qd->nq", m[r : r + ROWS], q[c : c + COLUMNS])
                    scores[np.isnan(scores)] = -np.inf
                    scores[names[rows[r : r + ROWS]][:, None] == own[columns][None, :]] = -np.inf
                    i, j = _best(scores, ranks[rows[r : r + ROWS]], k)
                    held = [np.concatenate(x) for x in zip(held, (rows[r + i], j, scores[i, j]), strict=True)]
                i, j, s = (x[held[2] > -np.inf] for x in held)
                order = np.lexsort((ranks[i], -s, j))
                keep = order[np.arange(len(j)) - np.searchsorted(j[order], j[order]) < k]
                out.append((columns[j[keep]], i[keep], s[keep]))
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0))
        return pa.table({"query_id": asked.take(pa.array(q)), "vec_id": ids.take(pa.array(i)), "score": pa.array(s, pa.float64())})

    return run


def _scored(tiles: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each tile (vb, qb)."""
    kinds = [f.dataType.simpleString() for f in (queries.schema["id"], vectors.schema["id"])]
    left, right = (x.join(tiles, by).select(F.col("vb").alias(f"{by}1"), F.col("qb").alias(f"{by}2"), "id", "v") for x, by in ((vectors, "vb"), (queries, "qb")))
    return left.groupBy("vb1", "vb2").cogroup(right.groupBy("qb1", "qb2")).applyInArrow(_tile(k), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")


def needed_tiles(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(vb, qb) of the tiles that can hold one of the k best of a query.

    Every query is scored against the block of the largest norms first. The k-th score found, over the query's norm, is
    the norm that a vector must have to matter, and a block of queries needs the blocks that have the least of these.
    """
    blocks = queries.select("qb").distinct()
    first = _scored(blocks.select(F.lit(0).alias("vb"), "qb"), vectors.where("vb = 0"), queries, k)
    known = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    # Scores are sums in floating point, so a block that is just below the bound is read too.
    reach = F.when(F.col("norm") > 0, F.col("least") / F.col("norm") * (1 - F.signum("least") * 1e-9))
    asked = queries.join(known, queries["id"] == known["query_id"], "left").groupBy("qb").agg(F.min(F.coalesce(reach, F.lit(float("-inf")))).alias("reach"))
    top = vectors.groupBy("vb").agg(F.max("norm").alias("top"))
    return top.join(asked, F.col("top") >= F.col("reach")).select("vb", "qb")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``vectors`` (vec_id, v) for each of (query_id, q).

    A query's own row, rows of another length, and null or empty vectors or ones with nulls take no part; ties go to the smaller
    vec_id. query_id is a key: rows that repeat one are answered as one query. Vectors and queries are put into blocks of like norm,
    and only tiles that can hold one of the best are scored, all in one job. A tile holds VECTORS and QUERIES rows at
    most, or about that; a vector goes to as many tiles as there are blocks of queries that need it.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked, _ = _blocks(queries.select(F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v")), QUERIES, "qb")
    rows, parts = _blocks(vectors.select(F.col("vec_id").alias("id"), F.col("v").cast("array<double>").alias("v")), VECTORS, "vb")
    tiles = written(needed_tiles(rows, asked, k)) if parts > 1 else asked.select(F.lit(0).alias("vb"), "qb").distinct()
    found = _scored(tiles, rows, asked, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
