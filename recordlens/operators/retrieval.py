"""Similarity and lexical retrieval over records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import DIMENSION, embedding
from recordlens.functions.parallel import slices, spread

#: Token budgets that retrieved contexts are compared with.
BUDGETS = {"MICRO": 8192, "STANDARD": 24576, "FULL": 131072}


def text_topk(rows: DataFrame, key: str, text: str, query: str, k: int = 5) -> DataFrame:
    """The ``k`` rows most like a query text by the inner product of their embeddings; ties to the smaller key.

    Every row is scored, those that share nothing with the query or have no tokens too. Rows are embedded and
    stored as 16-bit floats, the query is not; the rank is by the unrounded score. A query without tokens is refused.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = embedding(query)
    if not asked.any():
        raise ValueError("the query has no tokens")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            vectors = np.array([embedding(t.as_py() or "") for t in b.column(1)]).reshape(-1, DIMENSION)
            scores = (vectors.astype("<f2").astype(np.float64) * asked).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], [key, "score"])

    scored = spread(rows.select(key, F.col(text).cast("string"))).mapInArrow(run, f"{key} {kind}, score double")
    return scored.orderBy(F.desc("score"), key).limit(k).select(key, F.round("score", 6).alias("score"))


def retrieval_report(results: DataFrame) -> DataFrame:
    """One row from (hit, tokens, closed) per query: hit rate, mean tokens, reduction for each budget."""
    mean = F.avg("tokens")
    return results.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("hit").alias("hits"),
        F.bround(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"),
        F.bround(mean, 3).alias("mean_tokens"),
        *(F.bround(1 - mean / b, 6).alias(f"reduction_{name.lower()}") for name, b in BUDGETS.items()),
        F.bool_and("closed").alias("all_closed"),
    )


def render_context(rows: DataFrame, by: list[str], order: list[str], line: Column) -> DataFrame:
    """One text per group, its lines in order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(packed, lambda r: r["__line"]), "\n").alias("context"))
