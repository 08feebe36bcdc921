"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordlens.llm import centroids, concurrency, hmm, linededup, mixing, packing, pii, quality, secrets, sharding, simhash, topk, weaklabels
from recordlens.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents. Null and empty texts are fingerprint zero; repeats come as often as they are."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of all documents. A null text has no words and fails; copies of a text count once for a host."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that recur, and whether anything is left. A null text has no lines and stays."""
    return linededup.report(table(spark, sf_dir, "documents"))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents. A null text has size 8; a null doc_id is the key 0."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and score of all documents. A null or empty text has no words; its votes count like any others."""
    return weaklabels.score(table(spark, sf_dir, "documents"))


def vocabulary() -> dict[str, str]:
    """Where the public vocabulary's two forms are on this machine."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences. A null or empty text is one piece with the end id alone."""
    return packing.pack(table(spark, sf_dir, "documents"), **vocabulary())


def op7_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of all documents. A null or empty text has no tokens and the priors' posterior."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.rates(table(spark, sf_dir, "documents"), labelled, mixing.WEIGHTS)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents. A null text is empty and has none."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents. A null text is empty and has none."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of each query among all. Vectors that are null or hold what is no number take no part."""
    return topk.topk(table(spark, sf_dir, "embeddings"))


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under unigrams and under the model. A null text is empty and has its end alone."""
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales of each nation from each moment that changes them. Sales that are never open take no part."""
    return concurrency.concurrency(*(table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")))


def op13_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of all vectors that take part, without the number of centroids each was compared with."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("compared")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality_rules": op2_quality_rules,
        "op3_template_lines": op3_template_lines,
        "op4_jump_shards": op4_jump_shards,
        "op5_weak_labels": op5_weak_labels,
        "op6_best_two_fit": op6_best_two_fit,
        "op7_soft_mix": op7_soft_mix,
        "op8_secrets": op8_secrets,
        "op9_pii": op9_pii,
        "op10_exact_topk": op10_exact_topk,
        "op11_hidden_markov": op11_hidden_markov,
        "op12_peak_concurrency": op12_peak_concurrency,
        "op13_annulus_clusters": op13_annulus_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.ORACLE_SQL,
        "op4_jump_shards": sharding.ORACLE_SQL,
        "op8_secrets": secrets.ORACLE_SQL,
        "op10_exact_topk": topk.ORACLE_SQL,
        "op12_peak_concurrency": concurrency.ORACLE_SQL,
        "op13_annulus_clusters": centroids.ORACLE_SQL,
    }
