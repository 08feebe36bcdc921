"""SimHash near-duplicates by anchor points (operator 1).

Fingerprints of 64 bits are compared only where they meet at an *anchor*. The threshold of three
differing bits over two halves leaves one half that differs in at most one bit. On a half, the anchors
are the words of the perfect Hamming code of length 31: every word lies within the covering radius 1 of
exactly one anchor, so two words at a distance of at most 1 both lie within 1 + 1 = 2 of the first one's
anchor. Each distinct fingerprint is replicated to all anchors within that distance of either half (31
on average), and fingerprints are compared per anchor on all 64 bits. No link can be missed, and an
anchor gets about one fingerprint in two million, apart from real neighbourhoods.

Within an anchor only a spanning forest of the links is returned, never all pairs; a crowded anchor is
compared by blocks of bits. Equal fingerprints are reduced to one row before anything is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.common import cut
from recordlens.llm.components import components

SEED = 42
THRESHOLD = 3
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
_SPACE = frozenset(b" \t\n\x0b\x0c\r")


def word_blocks(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of ``data`` in order, in lists from about ``block`` bytes each."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + block)
        while end < n and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 ``hashes`` have each bit set, lowest bit first."""
    n = len(hashes)
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(n, 8)
    whole = n // 255 * 255  # a byte lane holds 255 ones without a carry
    counts = np.zeros(64, np.int64)
    if whole:
        sums = lanes[:whole].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    if whole < n:
        counts += lanes[whole:].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    return counts


def fingerprint(data: bytes, width: int = 3) -> int:
    """The SimHash of a text given as UTF-8; 0 for a text without words."""
    digest, counts, total, last = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = last + words
        n = len(words) - width + 1
        if n > 0:
            grams = zip(*(words[i:] for i in range(width)), strict=False)
            counts += bit_counts(np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, n))
            total += n
        last = words[-(width - 1) :] if width > 1 else []
    if not total:
        return digest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, th, fp): the fingerprint of each row's whole text as a signed long. A null text has no words."""

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


#: Parity checks of the Hamming code: bit j of the syndrome covers the positions (from 1) with bit j set.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
#: For each syndrome, the pairs of positions that cancel it, as masks.
_PAIRS = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] if s else [0] * 15 for s in range(32)], np.uint64)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 31-bit words: (row, anchor) for every anchor at a distance of at most 2."""
    syndrome = np.zeros(len(half), np.int64)
    for j, mask in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(half & np.uint64(mask)).astype(np.int64) & 1) << j
    rows = np.arange(len(half))
    home = np.where(syndrome > 0, half ^ (np.uint64(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint64)), half)
    off = rows[syndrome > 0]
    far = half[off, None] ^ _PAIRS[syndrome[off]]
    return np.concatenate([rows, np.repeat(off, far.shape[1])]), np.concatenate([home, far.ravel()])


def _replicate(batches):
    low31 = np.uint64((1 << 31) - 1)
    for b in batches:
        for at in range(0, b.num_rows, 8192):
            fp = np.asarray(b.column(0)[at : at + 8192])
            word = fp.view(np.uint64)
            for k in (0, 1):
                rows, found = anchors((word >> np.uint64(32 * k)) & low31)
                yield pa.RecordBatch.from_arrays([pa.array((found | np.uint64(k << 40)).view(np.int64)), pa.array(fp[rows])], ["anchor", "fp"])


#: Members of an anchor from which on they are compared by blocks of their bits.
CROWD = 512


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Edges (u, v) that connect what links of at most ``threshold`` bits connect.

    Up to CROWD distinct fingerprints are compared with each other. More are sorted into threshold + 1
    blocks of their bits, of which two linked ones share one, and each crowd of equal blocks is compared by itself.
    Within a comparison there are fewer edges than members.
    """
    if len(fps) > CROWD:
        edges, width = [], 64 // (threshold + 1)
        for i in range(threshold + 1):
            last = 64 - width * i if i == threshold else width
            block = (fps >> np.uint64(width * i)) & np.uint64((1 << last) - 1)
            order = np.argsort(block, kind="stable")
            bounds = np.flatnonzero(np.diff(block[order])) + 1
            edges += [_close(part, threshold) for part in np.split(fps[order], bounds) if len(part) > 1]
        return np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)
    return _close(fps, threshold)


def _close(fps: np.ndarray, threshold: int) -> np.ndarray:
    edges = [np.zeros((0, 2), np.uint64)]
    while len(fps) > 1:
        queue, fps = [fps[0]], fps[1:]
        while queue and len(fps):
            fp = queue.pop()
            near = np.bitwise_count(fps ^ fp) <= threshold
            if near.any():
                queue += fps[near].tolist()
                edges.append(np.stack([np.full(int(near.sum()), fp, np.uint64), fps[near]], axis=1))
                fps = fps[~near]
    return np.concatenate(edges)


def _compare(threshold: int):
    def run(batches):
        key, held = None, []  # the anchor that the last batch ended in, and its members so far
        for b in batches:
            if not b.num_rows:
                continue
            k, f = np.asarray(b.column(0)), np.asarray(b.column(1)).view(np.uint64)
            first, last = int(np.searchsorted(k, k[0], side="right")), int(np.searchsorted(k, k[-1]))
            if key == k[0]:
                held.append(f[:first])
                if first == len(k):
                    continue
                yield from _edges(np.zeros(sum(map(len, held)), np.int64), np.concatenate(held), threshold)
                yield from _edges(k[first:last], f[first:last], threshold)
            else:
                if held:
                    yield from _edges(np.zeros(sum(map(len, held)), np.int64), np.concatenate(held), threshold)
                yield from _edges(k[:last], f[:last], threshold)
            key, held = k[-1], [f[last:]]
        if held:
            yield from _edges(np.zeros(sum(map(len, held)), np.int64), np.concatenate(held), threshold)

    return run


def _edges(k, f, threshold):
    if len(k) < 2:
        return
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.concatenate([start, [len(k)]]))
    two = start[size == 2]
    two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= threshold]
    found = [np.stack([f[two], f[two + 1]], axis=1)]
    found += [forest(f[s : s + n], threshold) for s, n in zip(start[size > 2], size[size > 2], strict=True)]
    uv = np.concatenate(found).view(np.int64)
    if len(uv):
        yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])


def _grouped(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id, text hash and fingerprint; and of each fingerprint its component.

    Fingerprints are the nodes, so one that only rows without a doc_id have links like any other.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("threshold must be from 0 to 3")
    marked = cut(fingerprints(docs, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("fp_rows")))
    spread = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    met = spread.repartition("anchor").sortWithinPartitions("anchor")
    stars = components(met.mapInArrow(_compare(threshold), "u long, v long"))
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least", "fp_rows"
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, rooted.select("fp", "root", "fp_rows").join(names, "root")


def linked(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, hash, root): each row's id, the hash of its text and the fingerprint that names its component."""
    marked, named = _grouped(docs, width, threshold)
    return marked.join(named, "fp").select("doc_id", F.col("th").alias("hash"), "root").distinct()


def simhash_components(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    that links reach, itself included) and fp_rows (rows with the same fingerprint, a hint at copies).
    Null, empty and blank texts have the fingerprint zero and link like any other. Rows with a null
    doc_id link and bridge like others, but a null is never a component_id unless the component has
    nothing else. Repeated rows are returned as often as they come. No rows give no rows.
    ``threshold``: differing bits of a link, 3 at most (the anchors' radius is made for that).
    """
    marked, named = _grouped(docs, width, threshold)
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_rows"
    )


def dedup(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one with the smallest doc_id.

    Rows are told apart by doc_id and text, so a repeated doc_id with a text of another component stays too.
    A row with a null doc_id stays only if its component has no other; then one stays.
    """
    marked, named = _grouped(docs, width, threshold)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("one")
    stay = marked.join(named, "fp").groupBy("root").agg(one).select(F.col("one.doc_id").alias("__id"), F.col("one.th").alias("__th"))
    # The row travels as one value, so that no name in it can clash with those used here.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi")
    return kept.dropDuplicates(["id", "th"]).select("row.*")
