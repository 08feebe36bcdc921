"""Quality classifier from weak labels (operator 5).

Simple heuristics vote good, bad or nothing on every document. How often each pattern of votes occurs,
over all documents, is all that expectation-maximisation needs to estimate how accurate each heuristic
is, without any labels: the patterns are bounded by 3 to the number of heuristics. The patterns'
posteriors then label a bounded sample of documents, on which a hashed linear scorer is trained; it
scores every document by its whole text. Texts are read once: votes and feature counts are written, and
estimation, training and scoring read those.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import chosen, cut

#: Hashed features, a power of two; the weights are a vector of that length.
FEATURES = 1 << 15
#: Documents that the scorer is trained on at most, those of the smallest hashes, and bytes of their features.
TRAIN_DOCS, TRAIN_BYTES = 12_000, 64 << 20
#: Words that a worker remembers the features of.
CACHE_WORDS = 300_000
ABSTAIN, BAD, GOOD = 0, 1, 2

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from he in is it of on or that the this to was were with "
    "au dans de des du elle en est et la le les ou par pas pour que qui sur un une "
    "auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "al con del el las lo los por se su".split()
)
_SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~=]")
_MARKED = re.compile(r"[^\W_][#*$%&|<>!?]{2,}(?!\S)|(?<!\S)[|#*]+(?!\S)")
_SHOUTS = re.compile(r"[!?]{2,}")
_ENDS = re.compile(r"[.!?](?!\S)")
_LETTERS, _CAPITALS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-Þ]"), re.compile(r"\d+")


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def shape(word: str) -> str:
    """A word with its letters and digits folded: Ab9!! for Word1234!!."""
    return _DIGITS.sub("9", _LETTERS.sub(lambda m: ("A" if _CAPITALS.match(m.group()) else "") + ("B" if m.group().isupper() else "b"), word))


class Words(dict):
    """What is known of each word, packed: its two features, whether it is a function word, whether in capitals."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        own, folded = zlib.crc32(word.lower().encode()) % FEATURES, zlib.crc32(b"\0" + shape(word).encode()) % FEATURES
        value = self[word] = struct.pack("<4H", own, folded, word.lower().strip(".,;:") in STOP_WORDS, word.isupper() and len(word) > 1)
        return value


#: The feature of a word that equals the one before it.
SAME = zlib.crc32(b"\1same") % FEATURES


class Document:
    """The figures that the heuristics look at, and the counts of the features."""

    def __init__(self, text: str, known: Words | None = None):
        words = text.split()
        self.n = len(words)
        n = max(self.n, 1)
        self.symbols = len(_SYMBOLS.findall(text)) / n
        self.marked = len(_MARKED.findall(text)) / n
        self.shouts = len(_SHOUTS.findall(text)) / n
        held = Counter(words)
        self.table = np.frombuffer(b"".join(map((Words() if known is None else known).__getitem__, held)), "<u2").reshape(-1, 4)
        self.times = np.fromiter(held.values(), np.int64, len(held))
        self.same = sum(map(eq, words, words[1:]))
        self.stops, self.capitals = (self.times @ self.table[:, 2:]) / n
        self.distinct = len(held) / n
        self.stutter = self.same / n
        self.ends = len(_ENDS.findall(text)) / n
        lines = [x.rstrip() for x in text.split("\n") if x.strip()]
        self.once = len(set(lines)) / max(len(lines), 1)

    def features(self) -> tuple[bytes, bytes]:
        """The document's features and how often it has them, as 16-bit numbers; a larger count comes in parts."""
        at = np.concatenate([self.table[:, 0], self.table[:, 1], [SAME] if self.same else []]).astype(np.int64)
        found, place = np.unique(at, return_inverse=True)
        n = np.bincount(place, np.concatenate([self.times, self.times, [self.same] if self.same else []])).astype(np.int64)
        if len(n) and n.max() > 65535:
            parts = -(-n // 65535)
            found, whole = np.repeat(found, parts), np.repeat(n, parts)
            nth = np.arange(len(found)) - np.repeat(np.cumsum(parts) - parts, parts)
            n = np.minimum(whole - 65535 * nth, 65535)
        return found.astype("<u2").tobytes(), n.astype("<u2").tobytes()


#: Name and vote of each heuristic.
LABELLERS: tuple[tuple[str, Callable[[Document], int]], ...] = (
    ("symbols", lambda d: _vote(d.symbols > 0.15, d.symbols < 0.03)),
    ("marked_words", lambda d: _vote(d.marked > 0.15, d.marked < 0.02)),
    ("shouting", lambda d: _vote(d.shouts > 0.1, d.shouts < 0.02)),
    ("capitals", lambda d: _vote(d.capitals > 0.3, d.capitals < 0.1)),
    ("function_words", lambda d: _vote(d.n >= 20 and d.stops < 0.05, d.stops > 0.12)),
    ("variety", lambda d: _vote(d.n >= 50 and d.distinct < 0.2, d.n < 50 or d.distinct > 0.35)),
    ("stutter", lambda d: _vote(d.n >= 8 and d.stutter > 0.2, d.stutter < 0.05)),
    ("sentences", lambda d: _vote(d.n >= 30 and d.ends < 0.02, d.ends > 0.04)),
    ("repeated_lines", lambda d: _vote(d.once < 0.5, d.once > 0.8)),
)


def votes(document: Document) -> int:
    """The pattern of votes as a number in base 3, the first heuristic lowest."""
    return sum(rule(document) * 3**k for k, (_, rule) in enumerate(LABELLERS))


def digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


#: The belief that a vote is right on bad and on good documents before any is seen, and its weight as a share of all documents.
BELIEF, WEIGHT = (0.5, 0.95), 0.005


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: (posterior of good by pattern, accuracies, prior).

    accuracies[j, c]: how often heuristic j, when it votes, is right on documents of class c (0 bad, 1
    good). It starts from the belief that a vote of bad is rarely a false alarm while each heuristic sees
    only half of what is bad, which settles which class is which. That belief weighs as much as WEIGHT of the
    documents, so a heuristic with many false alarms is found out.
    """
    v = digits(patterns)
    prior, accuracy = 0.7, np.tile(BELIEF, (len(LABELLERS), 1))
    posterior = np.full(len(patterns), prior)
    if not len(patterns):
        return posterior, accuracy, prior
    weight = 1.0 + WEIGHT * counts.sum()
    for _ in range(rounds):
        good = np.where(v == GOOD, np.log(accuracy[:, 1]), np.where(v == BAD, np.log(1 - accuracy[:, 1]), 0.0)).sum(axis=1)
        bad = np.where(v == BAD, np.log(accuracy[:, 0]), np.where(v == GOOD, np.log(1 - accuracy[:, 0]), 0.0)).sum(axis=1)
        odds = np.clip(good - bad + np.log(prior / (1 - prior)), -40, 40)
        before, posterior = posterior, 1 / (1 + np.exp(-odds))
        for c, p in ((0, 1 - posterior), (1, posterior)):
            mass = (counts * p)[:, None]
            right = (mass * (v == (GOOD if c else BAD))).sum(axis=0) + BELIEF[c] * weight
            accuracy[:, c] = np.clip(right / ((mass * (v != ABSTAIN)).sum(axis=0) + weight), 0.005, 0.995)
        prior = float(np.clip((counts * posterior).sum() / max(counts.sum(), 1), 0.05, 0.95))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return posterior, accuracy, prior


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear scorer from (features, shares, soft label): logistic loss, Adam."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not rows:
        return weights, bias
    size = np.array([len(r[0]) for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    at, share, label = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([r[2] for r in rows])
    used, at = np.unique(at, return_inverse=True)
    at = at.astype(np.int32)
    w, m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    scale, before = 20.0, np.inf
    for t in range(1, rounds + 1):
        z = np.bincount(row, share * w[at], len(rows)) * scale + w[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - label
        if t % 10 == 0:  # done when ten rounds bring the mean gap to the labels less than a fiftieth nearer
            if (now := np.abs(gap).mean()) > 0.98 * before:
                break
            before = now
        g = np.append(np.bincount(at, share * gap[row], len(used)) * scale, gap.sum()) / len(rows) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    weights[used] = w[:-1] * scale
    return weights, float(w[-1])


def read(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, pick (a hash of doc_id and text), pattern of votes, words, features and their counts."""

    def run(batches):
        known = Words()
        for b in batches:
            out = [[] for _ in range(4)]
            for t in b.column(2):
                document = Document(t.as_py() or "", known)
                for column, x in zip(out, (votes(document), document.n, *document.features()), strict=True):
                    column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "pick", "pattern", "words", "at", "n"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("pick"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, pick long, pattern int, words long, at binary, n binary")


def voted(rows: DataFrame) -> tuple[dict[int, float], np.ndarray, int]:
    """From ``read`` rows: the posterior of good by pattern, the heuristics' accuracies, and the number of rows."""
    table = sorted((r[0], r[1]) for r in rows.groupBy("pattern").agg(F.count(F.lit(1))).collect())
    patterns = np.array([r[0] for r in table], np.int64).reshape(-1)
    counts = np.array([r[1] for r in table], np.float64).reshape(-1)
    posterior, accuracy, _ = estimate(patterns, counts)
    return dict(zip(patterns.tolist(), posterior.tolist(), strict=True)), accuracy, int(counts.sum())


def sample(rows: DataFrame, total: int, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> list:
    """The different documents of the smallest hashes: ``train_docs`` and ``train_bytes`` of features at most.

    Their sizes come to the driver first, then what fits. Repeats of a document are one.
    """
    hopeful = rows.where(chosen(2 * train_docs / max(total, 1), "pick")).select(F.xxhash64("pick").alias("order"), "pattern", "words", "at", "n").dropDuplicates(["order"])
    if hopeful.isEmpty():  # so few documents repeated so often that none is picked
        hopeful = rows.select(F.xxhash64("pick").alias("order"), "pattern", "words", "at", "n").dropDuplicates(["order"])
    sizes = hopeful.select("order", (F.octet_length("at") + F.octet_length("n")).alias("size")).orderBy("order").limit(train_docs).collect()
    spent = np.cumsum([r["size"] for r in sizes])
    fit_in = max(1, int(np.searchsorted(spent, train_bytes, side="right")))
    if not sizes:
        return []
    return sorted(hopeful.where(F.col("order") <= sizes[min(fit_in, len(sizes)) - 1]["order"]).collect())


def accuracies(docs: DataFrame) -> DataFrame:
    """(labeller, on_bad, on_good): how often each heuristic is estimated to be right when it votes."""
    _, accuracy, _ = voted(read(docs))
    return docs.sparkSession.createDataFrame(
        [(name, float(a[0]), float(a[1])) for (name, _), a in zip(LABELLERS, accuracy, strict=True)], "labeller string, on_bad double, on_good double"
    )


def score(docs: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are ignored) with its quality.

    Returns doc_id, votes_good, votes_bad, weak_good (the posterior of its votes), score (the linear
    scorer's probability of good) and kept (score of ``threshold`` or more). A null text is empty: it has
    no words and is scored by the bias alone. Rows come back as often as they come in, null doc_ids too.
    No rows give no rows. Only the scorer's training documents are sampled: ``train_docs`` at most, and
    TRAIN_BYTES of them; votes, their accuracies and scores cover all rows.
    """
    rows = cut(read(docs))
    label, _, total = voted(rows)
    unpack = lambda r: (np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u2") / max(r["words"], 1), label[r["pattern"]])
    weights, bias = fit([unpack(r) for r in sample(rows, total, train_docs)])
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias, label))

    def run(batches):
        w, b0, known = shared.value
        for b in batches:
            at, n = (np.frombuffer(b"".join(x.as_py() for x in b.column(i)), "<u2") for i in (3, 4))
            size = np.array([len(x.as_py()) // 2 for x in b.column(3)], np.int64)
            row = np.repeat(np.arange(len(size)), size)
            words = np.maximum(np.asarray(b.column(2)), 1)
            z = np.bincount(row, w[at] * n, len(size)) / words + b0
            p = 1 / (1 + np.exp(-np.clip(z, -40.0, 40.0)))
            patterns = np.asarray(b.column(1)).astype(np.int64)
            v = digits(patterns)
            weak = np.array([known[x] for x in patterns.tolist()], np.float64)
            columns = [pa.array((v == GOOD).sum(axis=1), pa.int32()), pa.array((v == BAD).sum(axis=1), pa.int32()), pa.array(weak), pa.array(p), pa.array(p >= threshold)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], _OUT)

    return rows.select("doc_id", "pattern", "words", "at", "n").mapInArrow(run, "doc_id long, votes_good int, votes_bad int, weak_good double, score double, kept boolean")


_OUT = ["doc_id", "votes_good", "votes_bad", "weak_good", "score", "kept"]
