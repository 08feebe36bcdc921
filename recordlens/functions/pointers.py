"""JSON pointers (RFC 6901) into JSON texts: reading, writing, selecting one record, ordering a collection.

The texts of a column are read in Arrow batches; what cannot be done comes back as an ``error`` beside the value,
so that a plan can turn it into findings or refuse.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.functions.hashing import canonical
from recordlens.functions.parallel import slices

_FOUND = "value string, error string"


class PointerError(ValueError):
    """A pointer that is not one, or that leads nowhere."""


def steps(pointer: str) -> list[str]:
    """The reference tokens of a pointer; the empty pointer has none and means the whole text."""
    if not pointer:
        return []
    if pointer[0] != "/":
        raise PointerError("a pointer is empty or begins with /")
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer[1:].split("/")]


def get(value, pointer: str):
    """What ``pointer`` leads to: names in objects, whole numbers from 0 in arrays."""
    for step in steps(pointer):
        if isinstance(value, dict):
            if step not in value:
                raise PointerError("not found")
            value = value[step]
        elif isinstance(value, list):
            if not step.lstrip("-").isdigit():
                raise PointerError("an array needs a whole number")
            if not 0 <= int(step) < len(value):
                raise PointerError("out of range")
            value = value[int(step)]
        else:
            raise PointerError("a scalar has no parts")
    return value


def put(record: dict, pointer: str, value) -> dict:
    """``record`` with ``value`` at ``pointer``; objects on the way are made, anything else on it is refused."""
    path = steps(pointer)
    if not path:
        raise PointerError("the whole record cannot be replaced")
    at = record
    for step in path[:-1]:
        if at.get(step) is None:
            at[step] = {}
        at = at[step]
        if not isinstance(at, dict):
            raise PointerError("something on the way is no object")
    at[path[-1]] = value
    return record


def _try(make) -> tuple[str | None, str | None]:
    try:
        return canonical(make()), None
    except ValueError as e:
        return None, str(e) if isinstance(e, PointerError) else "not a JSON text"


def pointer_get(payload: Column | str, pointer: str) -> Column:
    """(value: canonical JSON, error) at ``pointer`` in a JSON text; both null for a null text."""
    steps(pointer)

    def run(payload: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if s is None else _try(lambda s=s: get(json.loads(s), pointer)) for s in payload], columns=["value", "error"])

    return F.pandas_udf(run, _FOUND)(payload)


def pointer_put(payload: Column | str, pointer: str, value: Column | str) -> Column:
    """(value, error): the JSON text with the JSON ``value`` at ``pointer``; a null value writes null."""
    steps(pointer)

    def run(payload: pd.Series, value: pd.Series) -> pd.DataFrame:
        made = [(None, None) if s is None else _try(lambda s=s, v=v: put(json.loads(s), pointer, None if v is None else json.loads(v))) for s, v in zip(payload, value, strict=True)]
        return pd.DataFrame(made, columns=["value", "error"])

    return F.pandas_udf(run, _FOUND)(payload, value)


def select_one(rows: DataFrame, payload: str, pointer: str, equals) -> DataFrame:
    """The one row whose JSON text has ``equals`` at ``pointer``; refuses none and several."""
    wanted = canonical(equals)
    found = rows.withColumn("__at", pointer_get(payload, pointer)["value"]).where(F.col("__at") == F.lit(wanted)).drop("__at")
    n = found.limit(2).count()
    if n != 1:
        raise PointerError(f"{'no record' if not n else 'more than one record'} with the wanted value at {pointer}")
    return found


def sort_key(payload: Column | str, pointer: str) -> Column:
    """(kind, text, number, error) of what a collection is sorted by: texts by code point, numbers by size."""

    def one(s):
        if s is None:
            return None, None, None, "no record"
        try:
            value = get(json.loads(s), pointer)
        except ValueError as e:
            return None, None, None, str(e)
        if isinstance(value, (bool, int, float)):
            return "number", None, float(value), None
        return ("text", value, None, None) if isinstance(value, str) else (None, None, None, "neither a text nor a number")

    def run(payload: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(s) for s in payload], columns=["kind", "text", "number", "error"])

    return F.pandas_udf(run, "kind string, text string, number double, error string")(payload)


def require_sortable(rows: DataFrame, payload: str, pointer: str) -> None:
    """Refuse a collection whose records lack the place, or have texts and numbers there."""
    keyed = rows.select(sort_key(payload, pointer).alias("k"))
    kinds, errors = keyed.agg(F.count_distinct("k.kind"), F.count("k.error")).first()
    if errors or kinds > 1:
        raise PointerError(f"{pointer} does not order the collection: " + ("it is not there or no text or number" if errors else "texts and numbers are mixed"))


def sort_by_pointer(rows: DataFrame, payload: str, pointer: str, ordinal: str) -> DataFrame:
    """The rows in the order of what stands at ``pointer``; equal ones keep the order of ``ordinal``."""
    require_sortable(rows, payload, pointer)
    keyed = rows.withColumn("__k", sort_key(payload, pointer))
    return keyed.orderBy(F.col("__k.number"), F.col("__k.text"), ordinal).drop("__k")


def _walk(value, at: str):
    if isinstance(value, dict):
        for i, (k, v) in enumerate(value.items()):
            yield f"{at}/@{i}", k, True
            yield from _walk(v, f"{at}/@{i}")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from _walk(x, f"{at}/{i}")
    elif isinstance(value, str):
        yield at, value, False


#: Characters of leaves that are put out at a time; a single text may be longer.
LEAVES = 4 << 20


def _leaves(batches):
    names = ["key", "path", "text", "is_key"]
    for b in slices(batches, 64):
        nth, found, size = [], [], 0
        for i, s in enumerate(b.column(1)):
            for leaf in _walk(json.loads(s.as_py()), "") if s.is_valid else ():
                nth.append(i)
                found.append(leaf)
                size += len(leaf[0]) + len(leaf[1])
                if size > LEAVES:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(nth)), *_columns(found)], names)
                    nth, found, size = [], [], 0
        if found:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(nth)), *_columns(found)], names)


def _columns(found: list) -> list[pa.Array]:
    path, text, is_key = zip(*found, strict=True)
    return [pa.array(path, pa.string()), pa.array(text, pa.string()), pa.array(is_key, pa.bool_())]


def leaves(rows: DataFrame, key: str, payload: Column) -> DataFrame:
    """(key, path, text, is_key) of every key and every text in a JSON text; paths name places but not the keys below them.

    A Python worker holds a few texts' leaves at a time, however many rows Spark hands it at once.
    """
    picked = rows.select(F.col(key).alias("key"), payload.alias("payload"))
    return picked.mapInArrow(_leaves, f"key {picked.schema['key'].dataType.simpleString()}, path string, text string, is_key boolean")
