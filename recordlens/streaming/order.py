"""An extension: order checks and counts over a running stream of events.

The batch rule on the order of events has no streaming twin in the record model; these operators serve
event tables that arrive as files, with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, instant: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and key; events later than ``late`` behind the newest are not counted."""
    return (
        events.withWatermark(instant, late)
        .groupBy(F.window(instant, width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), by, "n")
    )


def distinct_events(events: DataFrame, instant: str, key: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark(instant, late).dropDuplicatesWithinWatermark([key])
