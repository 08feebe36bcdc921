"""The registered queries of the record engine and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name; a query gets a reader of tables by name."""

    def __init__(self):
        self.run: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(build):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            self.run[name] = query
            if sql:
                self.sql[name] = sql
            return build

        return register


def _all() -> list[Catalogue]:
    from recordlens.plans import bundles, evaluation, policies, records, registry, relations, storage, text

    return [text.QUERIES, relations.QUERIES, evaluation.QUERIES, records.QUERIES, registry.QUERIES, policies.QUERIES, bundles.QUERIES, storage.QUERIES]


def queries() -> dict[str, Query]:
    return {name: run for c in _all() for name, run in c.run.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for c in _all() for name, sql in c.sql.items()}
