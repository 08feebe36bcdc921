"""A session with the settings that the engine's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC and ANSI rules; adaptive execution splits skewed joins and merges small partitions.

    ``partitions`` should be two to four times the cores of the cluster; adaptive execution lowers it
    for small inputs. Other settings are passed on as they are.
    """
    builder = SparkSession.builder.appName("recordlens")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}),
        **conf,
    }
    return builder.config(map=settings).getOrCreate()
