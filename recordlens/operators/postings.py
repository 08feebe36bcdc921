"""Lexical top-k over an index of postings, which scores only the records that can reach a query's k-th score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from recordlens.functions.parallel import spread
from recordlens.functions.text import LOOKUP_TOKENS
from recordlens.operators.graph import written

#: Tokens with at most so many postings, as a multiple of k, are read for the first round, and one record in SAMPLE in whole.
SEED, SAMPLE = 64, 16
#: Tokens of three characters or more, which alone are compared: a run is always taken whole.
LONG_TOKENS = LOOKUP_TOKENS.removesuffix("+") + "{3,}"
#: Queries, and bytes of their phrases, that are sent to all tasks at once where no token can find a phrase.
PHRASES, PHRASE_BYTES = 1024, 8 << 20


def _tokens(low: Column, pattern: str = LOOKUP_TOKENS) -> Column:
    return F.regexp_extract_all(low, F.lit(pattern), F.lit(0))


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _first(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; the limit runs before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


class LexicalIndex:
    """Queries and records, ready to be scored: twice the shared tokens, and one if the record holds the query's phrase.

    ``queries``: (query_id, query); ``records``: (record_id, body). Ids are keys: bodies that share a record_id are one record,
    which holds the tokens and phrases of all; a null text is empty, rows without an id take no part. Only tokens that
    queries have are kept, as numbers, in one row a record; where these are few, Spark sends them to the records instead of
    shuffling the records' tokens.
    """

    def __init__(self, queries: DataFrame, records: DataFrame):
        asked = queries.where("query_id is not null").select("query_id", _low("query").alias("phrase"))
        long = F.array_distinct(_tokens(F.col("phrase"), LONG_TOKENS))
        whole = _tokens(F.col("phrase"))
        inner = F.size(F.array_distinct(F.filter(F.slice(whole, 2, F.greatest(F.size(whole) - 2, F.lit(0))), lambda x: F.length(x) > 2)))
        split = written(asked.select("query_id", "phrase", long.alias("words"), inner.alias("inner")))
        words = split.select("query_id", "phrase", F.explode("words").alias("word"))
        # Written, so that a word's number stays.
        numbers = written(words.select("word").distinct().select("word", F.monotonically_increasing_id().alias("token")))
        numbered = words.join(numbers, "word").select("query_id", "phrase", "token")
        tokens = numbered.groupBy("query_id", "phrase").agg(F.collect_list("token").alias("tokens"))
        none = F.array().cast("array<bigint>")
        self.asked = written(split.join(tokens, ["query_id", "phrase"], "left").select("query_id", "phrase", "inner", F.coalesce("tokens", none).alias("tokens")))
        self.records = records.where("record_id is not null").select("record_id", "body")
        terms = self.asked.select("query_id", F.explode("tokens").alias("token"))
        said = spread(self.records).select("record_id", F.explode(F.array_distinct(_tokens(_low("body"), LONG_TOKENS))).alias("word"))
        self.held = written(said.join(numbers, "word").groupBy("record_id").agg(F.collect_set("token").alias("held")))
        self.postings = self.held.select("record_id", F.explode("held").alias("token"))
        found = self.postings.groupBy("token").agg(F.count("*").alias("df"))
        # A query's tokens that any record has, from the rarest on; the others score nothing anywhere.
        self.terms = written(terms.join(found, "token").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "token"))))

    def shared(self, pairs: DataFrame) -> DataFrame:
        """(query_id, record_id, n) of (query_id, record_id): the tokens that both have."""
        n = F.size(F.array_intersect("tokens", "held"))
        both = pairs.join(self.held, "record_id").join(self.asked.select("query_id", "tokens"), "query_id")
        return both.select("query_id", "record_id", n.alias("n")).groupBy("query_id", "record_id").agg(F.max("n").alias("n"))

    def least(self, k: int) -> DataFrame:
        """(query_id, least): a number of tokens that k records are known to share, for queries with so many.

        The records are the best of those that rare tokens name and of one in SAMPLE of all, which grows with the
        records, so that those which can be better than the best of them are few however many there are.
        """
        rare = self.terms.where(F.col("df") <= SEED * k).join(self.postings, "token")
        sampled = self.terms.join(self.held.where(F.pmod(F.xxhash64("record_id"), F.lit(SAMPLE)) == 0).select("record_id", F.explode("held").alias("token")), "token")
        named = [x.groupBy("query_id", "record_id").agg(F.count("*").alias("n")) for x in (rare, sampled)]
        best = [_first(x, "query_id", [F.desc("n"), "record_id"], k).select("query_id", "record_id") for x in named]
        counted = self.shared(written(best[0].unionByName(best[1]).distinct()))
        top = _first(counted, "query_id", [F.desc("n"), "record_id"], k)
        return top.groupBy("query_id").agg(F.count("*").alias("known"), F.min("n").alias("least")).where(F.col("known") >= k).select("query_id", "least")

    def candidates(self, k: int) -> DataFrame:
        """(query_id, record_id): all pairs that share a token and can reach the k-th score, which few others can.

        A phrase adds one and a token two, so who shares fewer than ``least`` tokens comes after k others. A record that
        shares m tokens has at least one of all but the m - 1 most frequent ones; postings of the m - 1 are not read.
        """
        known = self.terms.groupBy("query_id").agg(F.count("*").alias("terms")).join(written(self.least(k)), "query_id", "left")
        bounds = known.select("query_id", (F.col("terms") - F.greatest(F.coalesce("least", F.lit(1)), F.lit(1)) + 1).alias("read"))
        # Written, so that Spark knows how few they are and sends them to the postings.
        terms = written(self.terms.join(bounds, "query_id").where(F.col("nth") <= F.col("read")).select("query_id", "token"))
        return terms.join(self.postings, "token").select("query_id", "record_id").distinct()

    def best(self, k: int) -> DataFrame:
        """(query_id, record_id, score): the k best of each query among the records that share a token with it.

        Texts are read only for pairs that share as many tokens as the k-th does and all inner ones of the phrase.
        """
        counted = written(self.shared(self.candidates(k)))
        floor = written(_first(counted, "query_id", [F.desc("n"), "record_id"], k).groupBy("query_id").agg(F.min("n").alias("floor")))
        near = counted.join(floor, "query_id").where(F.col("n") >= F.col("floor")).select("query_id", "record_id", "n")
        asked = self.asked.select("query_id", "phrase", "inner")
        doubtful = written(near.join(asked.select("query_id", "inner"), "query_id").where(F.col("n") >= F.col("inner")).select("query_id", "record_id").distinct())
        texts = self.records.join(doubtful, "record_id").join(asked, "query_id").where(F.contains(_low("body"), F.col("phrase")))
        hits = texts.select("query_id", "record_id", F.lit(1).alias("hit")).distinct()
        score = (2 * F.col("n") + F.coalesce("hit", F.lit(0))).cast("long")
        scored = near.join(hits, ["query_id", "record_id"], "left").select("query_id", "record_id", score.alias("score"))
        return _first(scored, "query_id", [F.desc("score"), "record_id"], k).drop("nth")


def _phrase_only(index: LexicalIndex, queries: DataFrame, k: int) -> list[DataFrame]:
    """(query_id, record_id, score 1) of records that hold the phrase of such ``queries``, the k smallest of each query.

    Every record is searched, for blocks of queries bounded in number and bytes.
    """
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    texts = spread(index.records).select("record_id", _low("body").alias("low"))
    blocks, out = max(-(-n // PHRASES), -(-size // PHRASE_BYTES)), []
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "phrase")
        hits = texts.join(F.broadcast(some), F.contains("low", "phrase")).select("query_id", "record_id").distinct()
        out.append(_first(hits, "query_id", ["record_id"], k).select("query_id", "record_id", F.lit(1).cast("long").alias("score")))
    return out


def lexical_topk(queries: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, record_id, score): twice the shared tokens, and one if the record holds the query's phrase.

    Every record has a score, zero where nothing is shared; ties go to the smaller record_id. Records are scored only
    where they can reach a query's k-th score. A phrase without inner tokens can be in records that share no token: if a query
    of that kind has fewer than k records above 1, all texts are searched for it.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    index = LexicalIndex(queries, records)
    best = written(index.best(k))
    # Queries with fewer than k records above 1 are filled from phrases that no token finds, then from zero scores.
    above = best.where("score > 1").groupBy("query_id").agg(F.count("*").alias("n"))
    short = written(index.asked.join(above, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", "phrase", "inner"))
    kind = records.schema["record_id"].dataType
    smallest = [r[0] for r in index.records.select("record_id").distinct().orderBy("record_id").limit(2 * k).collect()]
    ids = F.array(*map(F.lit, smallest)).cast(ArrayType(kind))
    zeros = short.select("query_id", F.explode(ids).alias("record_id"), F.lit(0).cast("long").alias("score"))
    parts = [best, *_phrase_only(index, short.where("inner = 0"), k), zeros]
    filled = reduce(DataFrame.unionByName, parts).groupBy("query_id", "record_id").agg(F.max("score").alias("score"))
    ranked = _first(filled, "query_id", [F.desc("score"), "record_id"], k)
    return ranked.select("query_id", F.col("nth").alias("rank"), "record_id", "score")


def scored_report(queries: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """(query_id, sharing, scored): records that share a token with the query, and those that were scored for it."""
    index = LexicalIndex(queries, records)
    sharing = index.terms.select("query_id", "token").join(index.postings, "token").groupBy("query_id").agg(F.count_distinct("record_id").alias("sharing"))
    scored = index.candidates(k).groupBy("query_id").agg(F.count("*").alias("scored"))
    none = F.lit(0).cast("long")
    joined = index.asked.select("query_id").distinct().join(sharing, "query_id", "left").join(scored, "query_id", "left")
    return joined.select("query_id", F.coalesce("sharing", none).alias("sharing"), F.coalesce("scored", none).alias("scored"))
