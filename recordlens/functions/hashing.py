"""Canonical JSON, digests, hashed embeddings, ratios."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.parallel import slices, spread
from recordlens.functions.text import JOINED, normal_text

DIMENSION = 256


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, raw UTF-8 and no NaN or infinity."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))


def canonical_json(payload: Column | str) -> Column:
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda s: None if s is None else canonical(json.loads(s)))

    return F.pandas_udf(run, "string")(payload)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def ordered_hash(rows: DataFrame, order: list[str], line: Column, by: list[str] | None = None, name: str = "digest") -> DataFrame:
    """The digest of all rows' ``line`` texts joined in the order of ``order``, of each group of ``by`` if given.

    A digest has one order, so a group is one stream through one task, which holds no more than the digest's state; Spark
    sorts the rows before it and spills what memory can't hold. Equal places are ordered by their lines. A null line
    is empty; without groups, no rows have the digest of an empty text.
    """
    by = by or []
    named = [F.col(c).alias(f"by{i}") for i, c in enumerate(by)] + [F.col(c).alias(f"at{i}") for i, c in enumerate(order)] + [line.alias("line")]
    groups, places = [f"by{i}" for i in range(len(by))], [f"at{i}" for i in range(len(order))]
    whole = rows.select(*named)
    dealt = (whole.repartition(*groups) if by else whole.repartition(1)).sortWithinPartitions(*groups, *places, "line").select(*groups, F.coalesce("line", F.lit("")).alias("line"))
    kinds = ", ".join([*(f"{g} {dealt.schema[g].dataType.simpleString()}" for g in groups), "digest string"])

    def run(batches):
        state, group, schema = None, None, None
        for b in batches:
            schema = b.schema
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(groups))), strict=True)) if groups else [()] * b.num_rows
            out = []
            for key, text in zip(keys, b.column(len(groups)).to_pylist(), strict=True):
                if state is None or key != group:
                    if state is not None:
                        out.append((group, state.hexdigest()))
                    state, group = hashlib.sha256(), key
                state.update(text.encode())
            if out:
                yield rows_of(out, schema)
        if state is not None:
            yield rows_of([(group, state.hexdigest())], schema)

    def rows_of(out, schema):
        columns = [pa.array([k[i] for k, _ in out], schema.field(i).type) for i in range(len(groups))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in out], pa.string())], [*groups, "digest"])

    digests = dealt.mapInArrow(run, kinds)
    if not by:
        return digests.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias(name))
    return digests.select(*(F.col(g).alias(c) for g, c in zip(groups, by, strict=True)), F.col("digest").alias(name))


def manifest_line(path: Column, digest: Column, size: Column) -> Column:
    return F.concat(path, F.lit("\0"), digest, F.lit("\0"), size.cast("string"), F.lit("\n"))


def ratio(part: Column, whole: Column, places: int = 6) -> Column:
    """part / whole, half to even; null if there is nothing to divide by."""
    return F.when(whole != 0, F.bround(part.cast("double") / whole, places))


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sums of a text's signed weights by bucket (a unigram weighs one, a bigram a half), and which were touched.

    Equal features are counted before they are hashed. No feature is remembered from text to text: most bigrams never come
    again, and a memory of them costs more than their digests.
    """
    tokens = JOINED.findall(normal_text(text))
    words, pairs, sha = Counter(tokens), Counter(zip(tokens, tokens[1:], strict=False)), hashlib.sha256
    data = {w: w.encode("utf-8", "surrogatepass") for w in words}
    digests = [sha(b"u\0" + d).digest()[:5] for d in data.values()]
    digests += [sha(b"b\0" + data[a] + b"\0" + data[b]).digest()[:5] for a, b in pairs]
    held = np.frombuffer(b"".join(digests), np.dtype([("place", "<u4"), ("sign", "u1")]))
    at = (held["place"] % DIMENSION).astype(np.int64)
    weights = np.concatenate([np.fromiter(words.values(), np.float64, len(words)), np.fromiter(pairs.values(), np.float64, len(pairs)) / 2])
    return np.bincount(at, np.where(held["sign"] & 1, weights, -weights), DIMENSION), np.bincount(at, minlength=DIMENSION) > 0


def embedding(text: str) -> np.ndarray:
    """The embedding of a text, of length one, or zero for a text without tokens."""
    sums, _ = feature_counts(text)
    norm = math.sqrt(float(sums @ sums))
    return sums / norm if norm else sums


def _sparse(rows: DataFrame, key: str, text: str, normed: bool) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            nth, dims, values = [], [], []
            for i, t in enumerate(b.column(1)):
                sums, touched = feature_counts(t.as_py() or "")
                norm = math.sqrt(float(sums @ sums))
                if normed and not norm:
                    continue
                at = np.flatnonzero(touched)
                nth.append(np.full(len(at), i))
                dims.append(at)
                values.append(sums[at] / norm if normed else sums[at])
            if nth:
                columns = [b.column(0).take(pa.array(np.concatenate(nth))), pa.array(np.concatenate(dims), pa.int32()), pa.array(np.concatenate(values))]
                yield pa.RecordBatch.from_arrays(columns, [key, "dim", "val"])

    return spread(rows.select(key, F.col(text).cast("string"))).mapInArrow(run, f"{key} {kind}, dim int, val double")


def feature_sums(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, val): sums of the signed weights by bucket of each row's text. A null text has none."""
    return _sparse(rows, key, text, False)


def embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, val): each row's embedding with length one, as sparse rows. A text without tokens has none."""
    return _sparse(rows, key, text, True)


def dense(sparse: DataFrame, key: str, dimension: int = DIMENSION) -> DataFrame:
    found = F.map_from_entries(F.collect_list(F.struct("dim", "val")))
    return sparse.groupBy(key).agg(found.alias("m")).select(
        key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def half_precision(vectors: Column | str) -> Column:
    """The values as they come back from 16-bit floats."""
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f2").astype(np.float64))

    return F.pandas_udf(run, "array<double>")(vectors)


def pack_f16(vectors: Column | str) -> Column:
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f2").tobytes())

    return F.pandas_udf(run, "binary")(vectors)


def unpack_f16(data: bytes, dimension: int = DIMENSION) -> np.ndarray:
    """The vectors of a packed file, a row each; refuses a torn file."""
    if len(data) % (2 * dimension):
        raise ValueError(f"{len(data)} bytes are not whole vectors of {dimension}")
    return np.frombuffer(data, "<f2").reshape(-1, dimension).astype(np.float64)
