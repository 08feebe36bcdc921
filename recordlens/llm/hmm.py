"""Hidden Markov language model: training by Baum-Welch, exact scores by the scaled forward recursion (operator 11).

The words of the training documents are counted by Spark. The most frequent ones, HEAD at most, are symbols of the model; all
others share one more symbol, the tail. Given the tail, a word has its share of the counts, which no state changes, so
the probability of a text is the model's for its symbols times the shares of its tail words. The symbols' tables are
bounded and go with the tasks; tail words find their counts in a join, which no word can make hot, since
a frequent one is a symbol.

The texts are encoded once, two bytes a token. In each round every task runs forward and backward over its training documents, adds
up expected starts, moves and emissions, and Spark sums those of all tasks as whole numbers, so their order has no effect. The
point the rounds start from is fitted on a bounded sample of training documents, SAMPLE_DOCS of at most SAMPLE_TOKENS; the
rounds cover all of them, whole. Recursions run over many segments of documents at once: a longer document is cut
into segments whose transfer matrices give the exact state before and after each one, so memory is bounded for any length.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import cut
from recordlens.llm.simhash import word_blocks

STATES = 8
ROUNDS = 3
#: Words with a symbol of their own; one more symbol is the tail, so that all fit into two bytes.
HEAD = 65_535
SAMPLE_DOCS, SAMPLE_TOKENS, SAMPLE_ROUNDS = 2_000, 2_048, 15
#: Tokens of a segment, and tokens whose recursion is held in memory at a time.
SEGMENT, HELD = 1_024, 1 << 18
#: Places after which the recursions are scaled again.
RESCALE = 8
#: A task hands on its word counts when it holds so many words or has read so many bytes since.
FLUSH_WORDS, FLUSH_BYTES = 300_000, 1 << 26
#: Longer words are known by their digest, so that keys and tables are bounded.
LONG = 32
#: Expected counts are summed in units of one to this.
UNIT = 1 << 20
END = b""


def key(word: bytes) -> bytes:
    """The word itself, or a blank and its SHA-256 if it is long; no word has a blank."""
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).digest()


def _count(batches):
    counts, read = Counter(), 0

    def out():
        merged = Counter()
        for w, n in counts.items():
            merged[key(w)] += n
        return pa.RecordBatch.from_arrays([pa.array(list(merged), pa.binary()), pa.array(list(merged.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for text in b.column(0).cast(pa.binary()):
            for words in word_blocks(text.as_py().lower()):
                counts.update(words)
                read += sum(map(len, words)) if len(words) < 64 else 1 << 20
                if len(counts) > FLUSH_WORDS or read > FLUSH_BYTES:
                    yield out()
                    counts, read = Counter(), 0
            counts[END] += 1
    if counts:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, lower-cased; each text's end is a word too. Long words are keys."""
    parts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(_count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class _Symbols(dict):
    """Symbols of words; what has none is the tail."""

    def __init__(self, head: list[bytes]):
        super().__init__(zip(head, range(len(head)), strict=True))
        self.tail = len(head)

    def __missing__(self, word: bytes) -> int:
        return self.get(key(word), self.tail) if len(word) > LONG else self.tail


def _encode(head):
    def run(batches):
        symbols = _Symbols(head.value)
        find, tail = symbols.__getitem__, symbols.tail
        for b in batches:
            rows, held = [], 0
            for at, text in enumerate(b.column(2).cast(pa.binary())):
                found, rest = [], Counter()
                for words in (*word_blocks(text.as_py().lower()), [END]):
                    s = np.fromiter(map(find, words), np.uint16, len(words))
                    found.append(s)
                    rest.update(key(words[i]) for i in np.flatnonzero(s == tail).tolist())
                whole = np.concatenate(found)
                rows.append((at, whole, rest))
                held += whole.nbytes
                if held > 1 << 23 or at == b.num_rows - 1:
                    some = b.slice(rows[0][0], len(rows))
                    ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
                    words = pa.array([w for r in rows for w in r[2]], pa.binary())
                    counts = pa.array([n for r in rows for n in r[2].values()], pa.int64())
                    rest = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, counts], ["word", "n"]))
                    columns = [some.column(0), some.column(1), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), rest]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "symbols", "rest"])
                    rows, held = [], 0

    return run


def encode(docs: DataFrame, held_out: Column, head: list[bytes]) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, symbols, rest): each text as its symbols, and its tail words with their numbers."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(head)
    coded = given.mapInArrow(_encode(words), "doc_id long, held_out boolean, n_tokens long, symbols binary, rest array<struct<word: binary, n: long>>")
    return cut(coded.withColumn("row", F.monotonically_increasing_id()))


@dataclass
class Model:
    """start[k], moves[k, j], and emits[s, k]: the probability of symbol s in state k."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


class _Packed:
    """Segments in order of length, longest first, laid out by time: those at place t are one run of rows."""

    def __init__(self, segments: list[np.ndarray]):
        sizes = np.array([len(s) for s in segments])
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.width = len(sizes) - np.searchsorted(self.sizes[::-1], np.arange(self.sizes[0]), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        self.symbols = np.empty(self.at[-1], np.intp)
        for i, nth in enumerate(self.order):
            self.symbols[self.at[: self.sizes[i]] + i] = segments[nth]

    def steps(self):
        return zip(range(len(self.width)), self.at[:-1].tolist(), self.width.tolist(), strict=True)


def _held(segments: list[np.ndarray], limit: int):
    """Indices of segments of like length, in groups of about ``limit`` tokens."""
    group, tokens = [], 0
    for i in sorted(range(len(segments)), key=lambda i: len(segments[i])):
        group.append(i)
        tokens += len(segments[i])
        if tokens >= limit:
            yield group
            group, tokens = [], 0
    if group:
        yield group


def _transfer(model: Model, segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The matrix from a distribution over states before a segment's first emission to that after its last, and its log10 scale."""
    k = len(model.start)
    matrices, logs = np.empty((len(segments), k, k)), np.zeros(len(segments))
    for group in _held(segments, HELD):
        packed = _Packed([segments[i] for i in group])
        e = model.emits[packed.symbols]
        m, scale = np.eye(k) * e[: packed.width[0], None, :], np.zeros(len(group))
        for t, at, n in packed.steps():
            if t:
                m[:n] = (m[:n].reshape(-1, k) @ model.moves).reshape(n, k, k) * e[at : at + n, None, :]
            if t % RESCALE == 0:
                most = m[:n].max(axis=(1, 2))
                m[:n] /= most[:, None, None]
                scale[:n] += np.log10(most)
        where = np.array(group)[packed.order]
        matrices[where], logs[where] = m, scale
    return matrices, logs


def _segments(doc: np.ndarray) -> list[np.ndarray]:
    return [doc[i : i + SEGMENT] for i in range(0, len(doc), SEGMENT)]


def _long(model: Model, docs: list[np.ndarray]):
    """(document's number, its segments' matrices, their scales) of the documents of more than one segment."""
    which = [i for i, d in enumerate(docs) if len(d) > SEGMENT]
    parts = [_segments(docs[i]) for i in which]
    matrices, logs = _transfer(model, [x for p in parts for x in p])
    ends = np.cumsum([0, *map(len, parts)])
    return [(i, matrices[a:b], logs[a:b]) for i, a, b in zip(which, ends[:-1], ends[1:], strict=True)]


def score(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each document's symbols."""
    found = np.zeros(len(docs))
    short = [i for i, d in enumerate(docs) if len(d) <= SEGMENT]
    texts, one = [docs[i] for i in short], np.ones(len(model.start))
    for group in _held(texts, HELD):
        packed = _Packed([texts[i] for i in group])
        e, sums = model.emits[packed.symbols], np.zeros(len(group))
        after = [*packed.width[1:].tolist(), 0]
        for t, at, n in packed.steps():
            a = (a[:n] @ model.moves if t else model.start) * e[at : at + n]  # noqa: F821
            if t % RESCALE == 0:
                c = a @ one
                a /= c[:, None]
                sums[:n] += np.log10(c)
            if after[t] < n:
                sums[after[t] : n] += np.log10(a[after[t] :] @ one)
        found[np.array(short)[np.array(group)[packed.order]]] = sums
    for i, matrices, logs in _long(model, docs):
        p, total = model.start, logs.sum()
        for m in matrices:
            a = p @ m
            total += np.log10(a.sum())
            p = a / a.sum() @ model.moves
        found[i] = total
    return found


class Expected:
    """Expected numbers of starts, moves and emissions under a model, added up over documents."""

    def __init__(self, model: Model):
        self.model, (k,) = model, model.start.shape
        self.start, self.moves, self.emits = np.zeros(k), np.zeros((k, k)), np.zeros(model.emits.shape)

    def add(self, docs: list[np.ndarray]) -> None:
        """Every segment with the exact distributions that the rest of its document gives it at both ends.

        Rows of the recursions may have any scale, as what is added up is made to sum to one at each place.
        """
        model, (k,) = self.model, self.model.start.shape
        segments, entry, leave, before = [], [], [], []
        known = {i: matrices for i, matrices, _ in _long(model, docs)}
        for i, d in enumerate(docs):
            segments += _segments(d)
            entry.append(model.start)
            before.append(np.zeros(k))
            behind = [np.ones(k)]
            if i in known:
                for m in known[i][:-1]:
                    a = entry[-1] @ m
                    before.append(a / a.sum())
                    entry.append(before[-1] @ model.moves)
                for m in known[i][:0:-1]:
                    b = model.moves @ (m @ behind[-1])
                    behind.append(b / b.sum())
            leave += behind[::-1]
        entry, leave, before = np.array(entry), np.array(leave), np.array(before)
        for group in _held(segments, HELD):
            self._add([segments[i] for i in group], entry[group], leave[group], before[group])

    def _add(self, segments, entry, leave, before) -> None:
        model, packed = self.model, _Packed(segments)
        entry, leave, before = entry[packed.order], leave[packed.order], before[packed.order]
        e, (k,) = model.emits[packed.symbols], model.start.shape
        alpha, beta, one, back = np.empty_like(e), np.empty_like(e), np.ones(k), np.ascontiguousarray(model.moves.T)
        for t, at, n in packed.steps():
            a = alpha[at : at + n]
            np.multiply(last[:n] @ model.moves if t else entry, e[at : at + n], out=a)  # noqa: F821
            if t % RESCALE == 0:
                a /= (a @ one)[:, None]
            last = a
        after, later = e, 0  # from here on, emission times what follows
        for t, at, n in reversed(list(packed.steps())):
            b = beta[at : at + n]
            if later:
                np.matmul(after[at + n : at + n + later], back, out=b[:later])
            b[later:] = leave[later:n]
            q = after[at : at + n]
            q *= b
            if t % RESCALE == 0:
                q /= (q @ one)[:, None]
            later = n
        first, w = packed.width[0], packed.width
        alpha_before = alpha[np.arange(first, len(alpha)) - np.repeat(w[:-1], w[1:])]
        inner = before.any(axis=1)
        for p, q in ((alpha_before, after[first:]), (before[inner], after[:first][inner])):
            self.moves += model.moves * ((p / np.einsum("ij,ij->i", p @ model.moves, q)[:, None]).T @ q)
        alpha *= beta
        alpha /= (alpha @ one)[:, None]
        self.start += alpha[:first][~inner].sum(axis=0)
        for j in range(k):
            self.emits[:, j] += np.bincount(packed.symbols, weights=alpha[:, j], minlength=len(self.emits))

    def model_of(self, unigrams: np.ndarray, discount: float) -> Model:
        """The next model: counts with ``discount`` taken off every emission and given to the unigrams."""
        k = len(self.start)
        off = np.minimum(self.emits, discount)
        total = self.emits.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            emits = (self.emits - off + off.sum(axis=0) * unigrams[:, None]) / total
        emits[:, total <= 0] = unigrams[:, None]
        moves = self.moves + 1
        return Model((self.start + 1) / (self.start.sum() + k), moves / moves.sum(axis=1, keepdims=True), np.ascontiguousarray(emits))


def first_model(unigrams: np.ndarray, states: int) -> Model:
    """States that differ a little from the unigrams, by a fixed seed."""
    rng = np.random.default_rng(11)
    emits = unigrams[:, None] * np.exp(rng.normal(0, 0.5, (len(unigrams), states)))
    moves = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(axis=0))


def _documents(batch, column):
    """Lists of a batch's documents, of about HELD tokens each or one longer document."""
    some, tokens = [], 0
    for x in batch.column(column):
        some.append(np.frombuffer(x.as_buffer(), np.uint16))
        tokens += len(some[-1])
        if tokens >= 4 * HELD:
            yield some
            some, tokens = [], 0
    if some:
        yield some


def _expect(model):
    """The task's expected counts: rows (what, each state's), a symbol's or -1 for starts, -2 - k for moves from state k."""

    def run(batches):
        sums = Expected(model.value)
        for b in batches:
            for docs in _documents(b, 0):
                sums.add(docs)
        rows = np.concatenate([sums.emits, sums.start[None], sums.moves])
        what = np.concatenate([np.arange(len(sums.emits)), -1 - np.arange(len(sums.moves) + 1)])
        whole = np.rint(rows * UNIT).astype(np.int64)
        some = whole.any(axis=1)
        counts = pa.FixedSizeListArray.from_arrays(pa.array(whole[some].ravel()), whole.shape[1]).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(what[some].astype(np.int32)), counts], ["what", "counts"])

    return run


def train(coded: DataFrame, unigrams: np.ndarray, discount: float, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training documents, from a start fitted on the sample."""
    known = coded.where("not held_out")
    sample = known.where(F.col("n_tokens") <= SAMPLE_TOKENS).orderBy(F.xxhash64("symbols"), "row").limit(SAMPLE_DOCS).select("symbols").collect()
    docs = [np.frombuffer(bytes(r.symbols), np.uint16) for r in sample]
    model = first_model(unigrams, states)
    for _ in range(SAMPLE_ROUNDS if docs else 0):
        sums = Expected(model)
        sums.add(docs)
        model = sums.model_of(unigrams, discount)
    for _ in range(rounds):
        sent = coded.sparkSession.sparkContext.broadcast(model)
        parts = known.select("symbols").mapInArrow(_expect(sent), "what int, counts array<long>")
        table = parts.groupBy("what").agg(*(F.sum(F.col("counts")[j]).alias(str(j)) for j in range(states))).toArrow()
        what, sums = table.column("what").to_numpy(), Expected(model)
        values = np.stack([table.column(str(j)).to_numpy() for j in range(states)], axis=1).astype(np.float64) / UNIT if len(what) else np.zeros((0, states))
        sums.emits[what[what >= 0]] = values[what >= 0]
        for w, v in zip(what[what < 0], values[what < 0], strict=True):
            if w == -1:
                sums.start[:] = v
            else:
                sums.moves[-2 - w] = v
        model = sums.model_of(unigrams, discount)
        sent.unpersist()
    return model


def _score(model, base):
    def run(batches):
        table = base.value
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                docs = [np.frombuffer(x.as_buffer(), np.uint16) for x in some.column(1)]
                known = [int(np.count_nonzero(d != len(table) - 1)) for d in docs]
                columns = [some.column(0), pa.array(known, pa.int64()), pa.array([float(table[d].sum()) for d in docs]), pa.array(score(model.value, docs))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "known", "base", "log"])

    return run


def held_out_rows(every: int = 7, remainder: int = 2) -> Column:
    """Documents that are not trained on, by the CRC-32 of doc_id as text; those without a doc_id are trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == remainder, F.lit(False))


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """log10 probability of every document under unigrams with one added, and under the hidden Markov model.

    ``docs`` has doc_id and text; other columns are ignored. Tokens are the lower-cased words and one end. A null text is empty and
    has the end alone; repeated rows count and are scored each. A null doc_id is trained on. A word that training has not seen is one
    more word to both models. No training documents leave one unseen word of probability 1; no rows give no rows. Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    spark, held = docs.sparkSession, held_out_rows()
    counts = cut(word_counts(docs.where(~held)))
    total, kinds, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = counts.orderBy(F.desc("n"), "word").limit(head).collect()
    words, numbers = [bytes(r.word) for r in top], np.array([r.n for r in top], np.int64)
    del top
    #: Absolute discounting: what is taken off each word seen is the share of words not seen.
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    unseen = discount * kinds / total if total else 1.0
    tail = (float(total - numbers.sum()) - discount * (kinds - len(words)) + discount * kinds) / total if total else 1.0
    unigrams = np.append((numbers - discount) / max(total, 1), tail)
    coded = encode(docs, held, words)
    model = train(coded, unigrams, discount, states, rounds)
    base = np.append(np.log10((numbers + 1) / (total + kinds + 1)), 0.0)
    sent = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(base)
    scored = coded.select("row", "symbols").mapInArrow(_score(*sent), "row long, known long, base double, log double")
    rest = coded.select("row", F.inline("rest")).withColumnRenamed("n", "times").join(counts.hint("merge"), "word", "left")
    share = F.when(F.col("n").isNull(), F.lit(unseen)).otherwise((F.col("n") - F.lit(discount)) / F.lit(max(total, 1))) / F.lit(tail)
    sums = rest.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("tail_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + kinds + 1)))).alias("tail_base"),
        F.sum(F.col("times") * F.log10(share)).alias("tail_log"),
    )
    zero = F.lit(0.0)
    return coded.select("row", "doc_id", "held_out", "n_tokens").join(scored, "row").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("log") + F.coalesce("tail_log", zero)).alias("score"),
    )
