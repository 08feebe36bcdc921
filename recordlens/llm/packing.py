"""Best-two-fit packing of token sequences (operator 6).

Texts become token ids in an Arrow pass. How many pieces there are of each length, at most ``capacity``
counts, is all that the driver needs to pack: it fills a bin greedily from the longest lengths left and
then tries to replace the bin's shortest document by two unpacked ones that fill its gap more tightly.
The same bin is repeated as long as the counts allow, so the plan has a few thousand patterns whatever
the number of documents. Pieces find their place by their rank among the pieces of their length; ranks
are counted per block of rows and length, so only a length's counts by block meet in one task, not its rows.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.common import cut

CAPACITY = 2048
END_ID = 0
#: Rows whose ranks are counted together.
BLOCK_ROWS = 1 << 20
#: Words that a worker remembers the ids of; all are forgotten when there are more.
CACHE_WORDS = 200_000


class _Odd(Exception):
    """A word that begins or ends with white space: the text must be split by the tokenizer itself."""


class Tokens:
    """Token ids of whole texts, as little-endian 32-bit bytes, with a memory for words.

    The vocabulary's splitting rule never joins what stands on both sides of a single space or line feed
    between other characters, and a space goes with the word behind it. So such words are encoded by
    themselves, once, and looked up from then on. Texts with any other white space are encoded whole.
    Words of Latin letters go through the same vocabulary as ranks, which is faster; all else through
    ``tokenizers``.
    """

    def __init__(self, path: str, ranks_path: str | None, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.spaced = _Words(self, "", limit), _Words(self, " ", limit)
        self.line = self.slow("\n")

    def slow(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        if self.fast and (text.isascii() or max(text) < "ɐ"):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return self.slow(text)

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # may be a special token
            return self.slow(text)
        try:
            first, spaced, out = self.first, self.spaced.__getitem__, []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                out += (self.line, first[head])
                out += map(spaced, rest)
            return b"".join(out[1:])
        except _Odd:
            return self.slow(text)


@lru_cache(maxsize=1)
def _tokens(path: str, ranks_path: str | None) -> Tokens:
    """One per worker process: tasks that follow each other in it share the vocabulary and the memory."""
    return Tokens(path, ranks_path)


class _Words(dict):
    def __init__(self, tokens: Tokens, before: str, limit: int):
        self.tokens, self.before, self.limit = tokens, before, limit

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        ids = self.tokens.word(self.before + word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


def pieces(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every text: doc_id, piece, start, length, ids_crc32, block and, if asked for, ids.

    A text's ids end with END_ID; texts of more than ``capacity`` ids are cut from the end into full
    pieces, so that only the first may be shorter. A null text is empty: one piece of one id.
    """

    def run(batches):
        tokens = _tokens(path, ranks_path)
        end, width = array("I", [END_ID]).tobytes(), 4 * capacity
        pid, row = TaskContext.get().partitionId(), 0
        for b in batches:
            out = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = tokens.encode(text.as_py() or "") + end if text.is_valid else end
                at, nth = 0, 0
                while at < len(ids):
                    size = width if at or len(ids) % width == 0 else len(ids) % width
                    some = ids[at : at + size]
                    for column, value in zip(out, (doc, nth, at // 4, size // 4, zlib.crc32(some), pid << 32 | row // BLOCK_ROWS, some), strict=True):
                        column.append(value)
                    at, nth, row = at + size, nth + 1, row + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 6 + with_ids]
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "block", "ids")[: 6 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _two(lengths: np.ndarray, counts: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over ``more_than`` and up to ``room``."""
    free = np.flatnonzero(counts > 0)
    free = free[free < room]
    if not len(free):
        return None
    partner = np.searchsorted(free, room - free, side="right") - 1
    ok = partner >= 0
    own = ok & (free[np.maximum(partner, 0)] == free) & (counts[free] < 2)
    partner = np.where(own, partner - 1, partner)
    ok &= partner >= 0
    # A pair may not use the one document of a length twice; the next shorter partner stands in for it.
    a, b = free[ok], free[partner[ok]]
    sound = (a != b) | (counts[a] >= 2)
    a, b = a[sound], b[sound]
    if not len(a):
        return None
    best = int(np.argmax(a + b))
    return (int(a[best]), int(b[best])) if a[best] + b[best] > more_than else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins for so many documents of each length: (lengths in a bin, longest first; how often)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit {capacity}")
        left[length] = n
    lengths = np.arange(capacity + 1)
    bins = []
    while left.any():
        held, gap = [], capacity
        while gap > 0:
            fits = np.flatnonzero(left[: gap + 1] > 0)
            if not len(fits):
                break
            best = int(fits[-1])
            held.append(best)
            left[best] -= 1
            gap -= best
        if gap and len(held) > 1 and (pair := _two(lengths, left, gap + held[-1], held[-1])):
            left[held.pop()] += 1
            for x in pair:
                held.append(x)
                left[x] -= 1
        used, n = np.unique(held, return_counts=True)
        times = 1 + int((left[used] // n).min())
        left[used] -= n * (times - 1)
        bins.append((tuple(sorted(held, reverse=True)), times))
    return bins


def _places(bins) -> tuple[np.ndarray, ...]:
    """For runs of ranks of a length: key (length and first rank), first sequence and offset; by key."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for held, times in bins:
        offset = 0
        for length in held:
            rank = seen.get(length, 0)
            rows.append((length << 48 | rank, rank, base, offset))
            seen[length] = rank + times
            offset += length
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def ranked(cutted: DataFrame) -> DataFrame:
    """``cutted`` with rank: its gapless place, from 0, among the pieces of its length."""
    counts = cutted.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    nth = cutted.withColumn("nth", F.row_number().over(within) - 1)
    return nth.join(offsets, ["length", "block"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth")


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All ``docs`` (doc_id, text; other columns are ignored) in sequences of at most ``capacity`` ids.

    Returns a row per piece: doc_id, piece (from 0), start, length, ids_crc32 (and ids, if asked for),
    sequence_id and offset. Null and empty texts are one piece with END_ID alone. Rows that repeat a
    doc_id, or have none, are packed as often as they come. No rows give no rows.
    """
    whole = cut(pieces(docs, path, ranks_path, capacity, with_ids))
    counts = {r[0]: r[1] for r in whole.groupBy("length").agg(F.count(F.lit(1))).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))
    placed = ranked(whole.select("doc_id", "piece", "start", "length", "ids_crc32", "block", *(["ids"] if with_ids else [])))

    def run(batches):
        keys, first, base, offset = shared.value
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(n))) for n in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            b = b.drop_columns(["rank"])
            b = b.append_column("sequence_id", pa.array(base[at] + rank - first[at]))
            yield b.append_column("offset", pa.array(offset[at]))

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out = placed.select(*names, "rank")
    schema = ", ".join(f"{n} {out.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return out.mapInArrow(run, schema)
