"""Probe suites: sources with their vocabularies, built cases, conditions in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.operators.relations import all_findings, findings
from recordlens.sources.files import jsonl_objects

TEXT = "string"
CASE_SCHEMA = (
    "id string, suite string, category string, prompt string, tags array<string>, expected struct<answer:string,canonical_ids:array<string>,"
    "provenance_refs:array<string>,epistemic_state:string,classification:string,sarcasm:string,hostility:string,intent_polarity:string,severity:string,freshness_limited:boolean>"
)


def _known(name: str, words: list[str]) -> Column:
    return F.coalesce(F.col(f"expected.{name}").isin(*words), F.lit(False))


def case_findings(cases: DataFrame, suite: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """What is wrong with a suite's cases, by the words that its expectations may use.

    ``vocabulary``: for epistemic_state, and for a suite of tone classification, sarcasm, hostility, intent_polarity
    and severity too, the words that are allowed. Ids must be there and not repeated.
    """
    at = F.coalesce("id", F.lit(""))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    odd_list = lambda n: F.coalesce(F.exists(f"expected.{n}", lambda x: x.isNull() | (x == "")), F.lit(False))
    rule = lambda bad, code: findings(cases.where(bad), f"probe.{code}", at, F.lit("missing or not valid"))
    return all_findings([
        rule(~F.col("suite").eqNullSafe(F.lit(suite)), "suite"),
        rule(F.coalesce(F.col("id") == "", F.lit(True)), "id"),
        findings(cases.where("id <> ''").groupBy("id").count().where("count > 1"), "probe.duplicate", F.col("id"), F.lit("id is repeated")),
        rule(F.coalesce(F.col("category") == "", F.lit(True)), "category"),
        rule(blank("prompt"), "prompt"),
        rule(F.col("tags").isNull(), "tags"),
        rule(F.col("expected").isNull(), "expected"),
        *(rule(F.col("expected").isNotNull() & odd_list(n), n) for n in ("canonical_ids", "provenance_refs")),
        *(rule(F.col("expected").isNotNull() & ~_known(n, words), n) for n, words in vocabulary.items()),
    ])


def load_suite(spark: SparkSession, path: str, suite: str, vocabulary: dict[str, list[str]]) -> DataFrame:
    """The cases of a JSONL file with their place (ordinal, from 0); refuses a file with findings."""
    cases = jsonl_objects(spark, path, CASE_SCHEMA)
    bad = case_findings(cases, suite, vocabulary).orderBy("code", "path").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{b['code']} {b['path']}" for b in bad))
    return cases.withColumn("ordinal", F.col("line") - 1).drop("line")


def built_cases(suites: list[DataFrame]) -> DataFrame:
    """All suites' cases as one relation; an id that is in two of them is refused."""
    out = suites[0]
    for s in suites[1:]:
        out = out.unionByName(s)
    twice = out.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids are repeated: {sorted(r['id'] for r in twice)}")
    return out


def condition_place(condition: Column, conditions: list[str]) -> Column:
    """The place of a condition in its declared order, from 0; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, conditions)), condition), F.lit(0)) - 1


def by_condition(rows: DataFrame, conditions: list[str], *first: str) -> DataFrame:
    """The rows in the order of ``first`` and then of their condition; an unknown condition is refused when the plan runs."""
    place = condition_place(F.col("condition"), conditions)
    checked = F.when(place.isNull(), F.raise_error(F.lit("a condition is not declared")).cast("long")).otherwise(place)
    return rows.orderBy(*first, checked)


def category_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category")
