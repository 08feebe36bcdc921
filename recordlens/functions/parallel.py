"""How many tasks work that costs time rather than bytes is dealt out to, and how much of a batch is worked on at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if the input is too small to give each of them a split; larger inputs stay as they are.

    A file of one row group is one task however many cores there are, and an hour of hashing is one core's.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * split else rows


#: Rows of an Arrow batch that are turned to Python values at a time.
SLICE = 256


def slices(batches, rows: int = SLICE):
    """The Arrow batches in slices of at most ``rows``, so that what is made of them does not grow with Spark's batches."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
