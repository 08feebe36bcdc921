"""Exact centroid clustering by annulus search (operator 13).

The centroids of a round are sorted by norm. For a vector x, the distance to the centroid whose norm is
nearest to its own is an upper bound u, and by the triangle inequality only centroids with norms from |x| - u to
|x| + u can be as near. That annulus is found by two binary searches, and its centroids are compared exactly,
ties at its border included: the bounds are widened by more than floating point can be wrong by.

A task keeps one sum and one count a cluster; Spark adds them up, and the new centroids, which are all that passes
through the driver, are exact. The vectors are written once as whole numbers and read in every round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import cut

CLUSTERS = 16
ROUNDS = 3
#: Vectors compared at a time in a task.
ROW_BLOCK = 4096
#: Components stay below this, so that a squared distance of 64 of them fits 64 bits.
LIMIT = 1 << 27
#: Up to this size, products of 64 components are exact as doubles.
EXACT = 1 << 22


def quantise(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, of the vectors that take part."""
    parts = F.col("embedding").cast("array<double>")
    sound = (F.size("embedding") == dims) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LIMIT))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where(F.coalesce(sound, F.lit(False)))
        .select("vec_id", F.transform(parts, lambda x: F.floor(x * scale).cast("int")).alias("q"))
    )


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors of the smallest SHA-256 of ``1:<vec_id>``; rows that repeat an id come in order of their components."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = whole.where("vec_id is not null").orderBy(digest, "q").limit(clusters).select("q").collect()
    return np.array([r.q for r in rows], np.int64)


class Annulus:
    """Centroids sorted by norm, ready to be searched."""

    def __init__(self, centroids: np.ndarray):
        squares = np.einsum("ij,ij->i", centroids, centroids)
        self.number = np.argsort(squares, kind="stable")
        self.centroids, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.small = np.abs(centroids).max(initial=0) <= EXACT

    def distances(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Squared distances of rows of ``x`` to the rows of ``c``, or to one ``c``."""
        off = x - c
        return np.einsum("ij,ij->i", off, off)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, centroids compared) of each row of ``x``."""
        squares = np.einsum("ij,ij->i", x, x)
        norms = np.sqrt(squares.astype(np.float64))
        above = np.clip(np.searchsorted(self.norms, norms), 1, len(self.norms) - 1) if len(self.norms) > 1 else np.zeros(len(x), np.int64)
        guess = np.where(norms - self.norms[above - 1] < self.norms[above] - norms, above - 1, above) if len(self.norms) > 1 else above
        best = self.distances(x, self.centroids[guess])
        number = self.number[guess]
        bound = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (1 + norms + bound)
        low = np.searchsorted(self.norms, norms - bound - slack, side="left")
        high = np.searchsorted(self.norms, norms + bound + slack, side="right")
        small = self.small and np.abs(x).max(initial=0) <= EXACT
        floats = x.astype(np.float64) if small else None
        for j, n in enumerate(self.number):
            rows = np.flatnonzero((low <= j) & (j < high) & (guess != j))
            if len(rows):
                if small:
                    off = squares[rows] - 2 * (floats[rows] @ self.centroids[j].astype(np.float64)).astype(np.int64) + self.squares[j]
                else:
                    off = self.distances(x[rows], self.centroids[j])
                nearer = (off < best[rows]) | ((off == best[rows]) & (n < number[rows]))
                best[rows[nearer]], number[rows[nearer]] = off[nearer], n
        return number, best, high - low


def _blocks(batches, dims: int):
    for b in batches:
        for at in range(0, b.num_rows, ROW_BLOCK):
            some = b.slice(at, ROW_BLOCK)
            yield some.column(0), some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(annulus: Annulus, dims: int):
    """The task's sum of each component and number of vectors of each cluster."""

    def run(batches):
        k = len(annulus.number)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, dims):
            number, _, _ = annulus.nearest(x)
            order = np.argsort(number, kind="stable")
            which, starts = np.unique(number[order], return_index=True)
            sums[which] += np.add.reduceat(x[order], starts, axis=0)
            counts += np.bincount(number, minlength=k)
        c, p = np.meshgrid(np.arange(k, dtype=np.int32), np.arange(dims, dtype=np.int32), indexing="ij")
        held = np.repeat(counts > 0, dims)
        columns = [c.ravel()[held], p.ravel()[held], sums.ravel()[held], np.repeat(counts, dims)[held]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["cluster", "place", "total", "n"])

    return run


def _assign(annulus: Annulus, dims: int):
    def run(batches):
        for ids, x in _blocks(batches, dims):
            number, best, compared = annulus.nearest(x)
            columns = [ids, pa.array(number.astype(np.int32)), pa.array(best), pa.array(compared.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "compared"])

    return run


def fit(whole: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` assignments, each the floor of its vectors' mean; empty ones stay."""
    dims = centroids.shape[1]
    for _ in range(rounds):
        parts = whole.mapInArrow(_sums(Annulus(centroids), dims), "cluster int, place int, total long, n long")
        centroids = centroids.copy()
        sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # a row a cluster and component
            centroids[r.cluster, r.place] = int(r.total) // r.n
    return centroids


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = 64, scale: int = 64) -> DataFrame:
    """Each vector's cluster after ``rounds`` rounds and one more assignment.

    ``vectors`` has vec_id and embedding; other columns are ignored. Vectors that are null, of other lengths, or
    that hold null or non-finite components take no part; nor do those with a component of 2**27 / ``scale`` or more, whose
    distances a long can't hold. Rows that repeat are vectors like others; a null vec_id is assigned
    but can't start a cluster. Fewer vectors than ``clusters`` give fewer clusters; none give no rows. Returns vec_id,
    cluster, distance (squared), compared (centroids in the annulus), cluster_inertia, inertia (at most the largest
    long) and centroid_sha256. The centroids, ``clusters`` rows of ``dims`` numbers, go with the tasks.
    """
    spark, whole = vectors.sparkSession, cut(quantise(vectors, dims, scale))
    start = first_centroids(whole, clusters)
    if not len(start):
        schema = "vec_id long, cluster int, distance long, compared int, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    final = fit(whole, start, rounds)
    assigned = cut(whole.mapInArrow(_assign(Annulus(final), dims), "vec_id long, cluster int, distance long, compared int"))
    each = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    most, everything = (1 << 63) - 1, sum(each.values())
    rows = [(c, min(n, most), min(everything, most), hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest()) for c, n in each.items()]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """SQL of one round: the assignment a<n> to the centroids c<n>, and the centroids c<n + 1>."""
    return f"""
a{n} AS (
  SELECT vid, arg_min(c, (d, c)) AS c FROM (
    SELECT v.vid, c{n}.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c{n}.q[i]) * (v.q[i] - c{n}.q[i])))::BIGINT AS d FROM v, c{n})
  GROUP BY vid
), s{n} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a{n}.c, unnest(v.q) AS x, unnest(range(1, 65)) AS i FROM v JOIN a{n} USING (vid)) GROUP BY c, i
), m{n} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{n} GROUP BY c
), c{n + 1} AS (
  SELECT c{n}.c, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (c)
)"""


#: The annulus' own column, compared, is left out by the query.
ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS vid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (
    SELECT sha256('1:' || vec_id::VARCHAR) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 16)
),{_round(0)},{_round(1)},{_round(2)}, last AS (
  SELECT vid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.vid, c3.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c3.q[i]) * (v.q[i] - c3.q[i])))::BIGINT AS d FROM v, c3)
  GROUP BY vid
)
SELECT vec_id, last.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM last JOIN v USING (vid) JOIN c3 USING (c)
"""
