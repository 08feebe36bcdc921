"""Line deduplication by a log-template tree (operator 3).

The tree has a fixed depth: a line goes to a node by its number of tokens and from there by its leading
tokens to a leaf. Tokens with a digit are variable fields. In a leaf a line joins the first template whose first
line it is like, if at least ``similarity`` of the tokens agree, and tokens that differ are variable fields of the
template; else it starts a template. The most frequent lines come first. A template in ``min_docs`` or more documents
recurs: its lines are dropped from all of them but the first, so nothing is lost from the corpus as a whole. The first
is the one with the smallest doc_id; rows without one come after all others, and texts of one doc_id in the order of their hash.

Equal lines are one row in a leaf, however often they occur, and a line alone in its leaf is its own template,
so its tokens are not moved. A leaf of more than CHUNK_LINES different lines is parsed in rounds, with the same result
as in one piece (``_templates``). A task holds the templates that it has found, not the lines, and
compares a line only with templates that agree with it in one of so many parts that one must agree.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut, drop_cuts, made_so_far
from recordlens.llm.quality import rewritten

LEADING = 3
#: Different lines of a leaf that one task parses in a round; lines that a task remembers to have sent the tokens of.
CHUNK_LINES, SENT_LINES = 100_000, 1_000_000
_DIGIT = re.compile(rb"[0-9]")
_FIELD = b"<*>"
_SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allowed_changes(n: int, similarity: float) -> int:
    """How many of ``n`` tokens may differ."""
    return int(n * (1 - similarity) + 1e-9)


def _read_lines(leading: int, similarity: float):
    """A row for each line with a token: document, place, leaf, hash, tokens; new: not seen in the document before.

    Tokens come once in a while for equal lines, and never for lines in which none may differ.
    """

    def run(batches):
        digest, sent = xxhash.xxh64_intdigest, set()
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, value in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                text = value.as_py() or b""
                key, seen = _signed(digest(text, _SEED)), set()
                for place, line in enumerate(text.split(b"\n")):
                    tokens = line.split()
                    if not tokens:
                        continue
                    if _DIGIT.search(line):
                        tokens = [_FIELD if _DIGIT.search(t) else t for t in tokens]
                    joined = b" ".join(tokens)
                    lh = _signed(digest(joined, _SEED))
                    leaf = _signed(digest(b"%d " % len(tokens) + b" ".join(tokens[:leading]), _SEED))
                    known = lh in sent or not allowed_changes(len(tokens), similarity)
                    if not known:
                        if len(sent) >= SENT_LINES:
                            sent.clear()
                        sent.add(lh)
                    new = lh not in seen
                    seen.add(lh)
                    for column, x in zip(out, (doc, key, place, leaf, lh, None if known else joined, new), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], _LINES)

    return run


_LINES = ["doc", "key", "place", "leaf", "lh", "tokens", "new"]
_LINES_SCHEMA = "doc long, key long, place int, leaf long, lh long, tokens binary, new boolean"


class Leaf:
    """The templates of a leaf in order, as rows of token numbers, and which of their tokens are variable fields.

    Of ``allowed`` + 1 parts of a line, apart from the ``leading`` tokens that all lines share, a line that may
    join a template agrees with its first line in one. So templates are listed by the contents of their parts.
    """

    #: Templates from which on the lists are used; fewer are all compared.
    FEW = 24

    def __init__(self, n: int, allowed: int, leading: int):
        self.n, self.allowed, self.size = n, allowed, 0
        self.rows, self.fields, self.numbers = np.zeros((4, n), np.int32), np.zeros((4, n), bool), {_FIELD: 0}
        free = np.arange(min(leading, n), n)
        self.parts = [(p[0], p[-1] + 1) for p in np.array_split(free, allowed + 1)] if len(free) > allowed else None
        self.lists: dict[tuple[int, bytes], list[int]] | None = None

    def _list(self, nth: int) -> None:
        for i, (a, b) in enumerate(self.parts):
            self.lists.setdefault((i, self.rows[nth, a:b].tobytes()), []).append(nth)

    def _numbered(self, tokens: list[bytes]):
        return np.array([self.numbers.setdefault(t, len(self.numbers)) for t in tokens], np.int32)

    def find(self, tokens: list[bytes], line=None) -> int | None:
        """The number of the first template that a line is like enough; its tokens that differ become variable fields."""
        line = self._numbered(tokens) if line is None else line
        if self.lists is None:
            some, rows = None, self.rows[: self.size]
        else:
            some = sorted({t for i, (a, b) in enumerate(self.parts) for t in self.lists.get((i, line[a:b].tobytes()), ())})
            rows = self.rows[some]
        near = np.flatnonzero((rows != line).sum(axis=1) <= self.allowed) if len(rows) else ()
        if not len(near):
            return None
        nth = int(near[0]) if some is None else some[near[0]]
        self.fields[nth] |= self.rows[nth] != line
        return nth

    def start(self, tokens: list[bytes], line=None) -> int:
        """The number of a new template with this line as its first."""
        if self.size == len(self.rows):
            self.rows, self.fields = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.fields))
        self.rows[self.size] = self._numbered(tokens) if line is None else line
        self.size += 1
        if self.lists is not None:
            self._list(self.size - 1)
        elif self.size > self.FEW and self.parts:
            self.lists = {}
            for nth in range(self.size):
                self._list(nth)
        return self.size - 1

    def join(self, tokens: list[bytes]) -> int:
        """The number of the template that a line joins or starts."""
        line = self._numbered(tokens)
        nth = self.find(tokens, line)
        return self.start(tokens, line) if nth is None else nth

    def templates(self) -> list[bytes]:
        """The templates' first lines with their variable fields."""
        names = list(self.numbers)
        return [b" ".join(_FIELD if f else names[x] for x, f in zip(r, fs, strict=True)) for r, fs in zip(self.rows[: self.size].tolist(), self.fields.tolist(), strict=False)]


_ROWS_SCHEMA = "leaf long, part int, parts int, block long, class int, lh long, tokens binary"


def _parse(similarity: float, leading: int):
    """From (a row's columns, given) in order: the rows that are not given, with the template of each, named after its first line."""

    def run(batches):
        at, leaf, first = None, None, []
        for b in batches:
            keep, names = [], []
            leaves, parts, lines, tokens, givens, starts = (b.column(i).to_pylist() for i in map(b.schema.names.index, ("leaf", "part", "lh", "tokens", "given", "starts")))
            for i, (leaf_id, part, lh, text, given, may_start) in enumerate(zip(leaves, parts, lines, tokens, givens, starts, strict=True)):
                words = text.split(b" ")
                if (leaf_id, part) != at:
                    at, first = (leaf_id, part), []
                    leaf = Leaf(len(words), allowed_changes(len(words), similarity), leading)
                if given:
                    leaf.start(words)
                    first.append(lh)
                    continue
                nth = leaf.join(words) if may_start else leaf.find(words)
                if nth == len(first):
                    first.append(lh)
                keep.append(i)
                names.append(None if nth is None else first[nth])
            out = b.select(_ROW_NAMES).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names, pa.int64())], [*_ROW_NAMES, "template"])

    return run


_ROW_NAMES = [c.split()[0] for c in _ROWS_SCHEMA.split(", ")]


def _parsed(rows: DataFrame, similarity: float, leading: int) -> DataFrame:
    """``rows`` with their templates; given ones first, then the most frequent, each part of a leaf by one task."""
    ordered = rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.desc("given"), F.desc("class"), "lh")
    return ordered.mapInArrow(_parse(similarity, leading), f"{_ROWS_SCHEMA}, template long")


def _templates(lines: DataFrame, counts: DataFrame, similarity: float, leading: int, chunk_lines: int) -> DataFrame:
    """(leaf, lh, template) of the lines that share their leaf with others.

    Lines are in the order of their class (the power of two of the documents that hold them, most first) and hash.
    A line joins the first template whose first line it is like enough. A leaf of more than ``chunk_lines`` lines
    comes in blocks of about so many consecutive ones: a round parses what is undecided of a block, and compares all
    undecided lines behind it, in parts of as many, with the templates that the block started. So blocks
    decide what runs when and never what comes out, and no task has more than a block of templates and a part of lines.
    """
    crowds = counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = lines.where("tokens is not null").select("leaf", "lh", "tokens").join(counts.join(crowds, "leaf"), ["leaf", "lh"])
    distinct = met.groupBy("leaf", "lh", "n", "size").agg(F.first("tokens").alias("tokens")).withColumn("class", F.floor(F.log2("n")).cast("int"))
    whole = distinct.where(F.col("size") <= chunk_lines).select("leaf", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.lit(0).cast("long").alias("block"), "class", "lh", "tokens")
    done = _parsed(whole.withColumn("given", F.lit(False)).withColumn("starts", F.lit(True)), similarity, leading).select("leaf", "lh", "template")
    if crowds.where(F.col("size") > chunk_lines).isEmpty():
        return done
    large = distinct.where(F.col("size") > chunk_lines)
    classes = large.groupBy("leaf", "class").agg(F.count(F.lit(1)).alias("lines"))
    above = Window.partitionBy("leaf").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before", F.coalesce(F.sum("lines").over(above), F.lit(0)))
    along = F.col("lh") / 2.0**64 + 0.5
    block = F.floor((F.col("before") + along * F.col("lines")) / chunk_lines)
    parts = F.ceil(F.col("size") / chunk_lines).cast("int")
    left = large.join(classes, ["leaf", "class"]).select(
        "leaf", F.pmod(F.xxhash64("lh"), parts).cast("int").alias("part"), parts.alias("parts"), block.alias("block"), "class", "lh", "tokens"
    )
    left = cut(left)
    while (now := left.agg(F.min("block")).first()[0]) is not None:
        at = F.col("block") == now
        first = left.where(at).withColumn("part", F.lit(0)).withColumn("given", F.lit(False)).withColumn("starts", F.lit(True))
        first = cut(_parsed(first, similarity, leading))
        done = done.unionByName(first.select("leaf", "lh", "template"))
        heads = first.where("lh = template").drop("template").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rest = heads.withColumn("given", F.lit(True)).unionByName(left.where(~at).withColumn("given", F.lit(False))).withColumn("starts", F.lit(False))
        rest = cut(_parsed(rest, similarity, leading))
        done = done.unionByName(rest.where("template is not null").select("leaf", "lh", "template"))
        left = rest.where("template is null").drop("template")
    return done


def recurring_lines(docs: DataFrame, min_docs: int = 2, similarity: float = 0.8, leading: int = LEADING, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The lines to drop: doc_id, key (hash of the text) and place (from 0) of each."""
    since = made_so_far()
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    lines = cut(texts.mapInArrow(_read_lines(leading, similarity), _LINES_SCHEMA))
    counts = cut(lines.groupBy("leaf", "lh").agg(F.count_if("new").alias("n")))
    parsed = _templates(lines, counts, similarity, leading, chunk_lines)
    named = counts.join(parsed, ["leaf", "lh"], "left").select("leaf", "lh", "n", F.coalesce("template", "lh").alias("template"))
    named = cut(named)
    hopeful = named.groupBy("leaf", "template").agg(F.sum("n").alias("all")).where(F.col("all") >= min_docs).select("leaf", "template")
    of_line = named.drop("n").join(hopeful, ["leaf", "template"])
    met = cut(lines.select("doc", "key", "place", "leaf", "lh").join(of_line, ["leaf", "lh"]).select("doc", "key", "place", "leaf", "template"))
    held = met.groupBy("leaf", "template", "doc", "key").agg(F.lit(1).alias("one"))
    place = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "key")
    often = held.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("stays"))
    # Written, so that both sides of the join below come straight from a shuffle and a template with a
    # large part of all lines can be split between tasks.
    often = cut(often.where(F.col("n_docs") >= min_docs))
    drop_cuts(docs.sparkSession, since, last=2)
    return (
        met.join(often, ["leaf", "template"])
        .where(~(F.col("doc").eqNullSafe(F.col("stays.doc")) & (F.col("key") == F.col("stays.key"))))
        .select(F.col("doc").alias("doc_id"), "key", "place", F.xxhash64("leaf", "template").alias("template"), "n_docs")
    )


def _joined(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, row, drop: places or null, left: the lines that stay) of each row."""
    drop = recurring_lines(docs, **options).groupBy("doc_id", "key").agg(F.collect_list("place").alias("drop"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The row travels as one value, so that no name in it can clash with those used here.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(drop, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("key")), "left")
    lines = F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n")
    return joined.select("id", "row", "drop", lines.alias("lines")).withColumn(
        "left", F.when(F.col("drop").isNotNull(), F.filter("lines", lambda x, i: ~F.array_contains(F.col("drop"), i))).otherwise(F.col("lines"))
    )


_HAS_TOKEN = r"[^\x20\x09-\x0D]"


def report(docs: DataFrame, **options) -> DataFrame:
    """Each row of ``docs`` (doc_id, text; others are ignored) after its recurring lines are dropped.

    Returns doc_id, n_lines (with a token), n_dropped, kept (false if lines were dropped and none with a
    token is left) and text. A null text has no lines, is kept and comes back empty. Rows that repeat are
    documents of their own if their doc_id or text differ. Of rows with a null doc_id one keeps a recurring line
    that no row with a doc_id holds. No rows give no rows. Options: min_docs, similarity, leading, chunk_lines.
    """
    lines = F.filter("lines", lambda x: x.rlike(_HAS_TOKEN))
    dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long")
    left = F.array_join("left", "\n")
    return _joined(docs.select("doc_id", "text"), **options).select(
        F.col("id").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
        ((dropped == 0) | left.rlike(_HAS_TOKEN)).alias("kept"),
        left.alias("text"),
    )


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without their recurring lines and without the rows that these leave empty; n_chars follows.

    All columns of ``docs`` are returned and no others. See ``report`` for nulls, repeats and empty tables.
    """
    left = F.array_join("left", "\n")
    out = _joined(docs, **options).where(F.col("drop").isNull() | left.rlike(_HAS_TOKEN))
    return rewritten(out, docs.columns, F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(left), F.col("drop").isNotNull())
