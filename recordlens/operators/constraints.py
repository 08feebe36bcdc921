"""A subset of JSON Schema as column predicates that yield findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
}
# What the formats accept.
_FORMATS = {"date": r"^\d{4}-\d\d-\d\d$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", "date-time": r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"}


def violations(schema: dict, value: Column, kind: T.DataType, path: str = "$") -> list[tuple[str, str, Column]]:
    """(path, keyword, predicate that is true where the keyword is violated) for a typed column.

    Null stands for absent: only ``required`` speaks of it. Supported: type, const, enum, pattern, format,
    minLength, maxLength, minimum, maximum, minItems, maxItems, uniqueItems, contains, items, required,
    properties, minProperties of maps, allOf, anyOf, oneOf, not, if/then/else.
    """
    found: list[tuple[str, str, Column]] = []
    there = value.isNotNull()

    def add(keyword: str, bad: Column) -> None:
        found.append((path, keyword, there & F.coalesce(bad, F.lit(False))))

    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if not any(isinstance(kind, _TYPES.get(n, ())) for n in names if n != "null"):
            add("type", F.lit(True))
    if "const" in schema:
        add("const", value != F.lit(schema["const"]))
    if "enum" in schema:
        add("enum", ~value.isin([x for x in schema["enum"] if x is not None]))
    if isinstance(kind, T.StringType):
        if "pattern" in schema:
            add("pattern", ~value.rlike(schema["pattern"]))
        if schema.get("format") in _FORMATS:
            add("format", ~value.rlike(_FORMATS[schema["format"]]))
        for keyword, bad in (("minLength", lambda n: F.char_length(value) < n), ("maxLength", lambda n: F.char_length(value) > n)):
            if keyword in schema:
                add(keyword, bad(schema[keyword]))
    for keyword, bad in (("minimum", lambda n: value < n), ("maximum", lambda n: value > n)):
        if keyword in schema and isinstance(kind, T.NumericType):
            add(keyword, bad(schema[keyword]))
    if isinstance(kind, T.ArrayType):
        for keyword, bad in (("minItems", lambda n: F.size(value) < n), ("maxItems", lambda n: F.size(value) > n)):
            if keyword in schema:
                add(keyword, bad(schema[keyword]))
        if schema.get("uniqueItems"):
            add("uniqueItems", F.size(F.array_distinct(value)) < F.size(value))
        for keyword in ("items", "contains"):
            if keyword in schema:
                bad_item = _item_violation(schema[keyword], kind.elementType, path)
                if keyword == "items":
                    add(keyword, F.exists(value, bad_item))
                else:
                    add(keyword, F.forall(value, bad_item))
    if isinstance(kind, T.MapType) and "minProperties" in schema:
        add("minProperties", F.size(value) < schema["minProperties"])
    if isinstance(kind, T.StructType):
        for name in schema.get("required", []):
            at = value[name] if name in kind.names else None
            found.append((f"{path}.{name}", "required", there & (at.isNull() if at is not None else F.lit(True))))
        for name, inner in schema.get("properties", {}).items():
            if name in kind.names:
                found += violations(inner, value[name], kind[name].dataType, f"{path}.{name}")
    for inner in schema.get("allOf", []):
        found += violations(inner, value, kind, path)
    bad = {k: [_any(violations(s, value, kind, path)) for s in schema.get(k, [])] for k in ("anyOf", "oneOf")}
    if bad["anyOf"]:
        add("anyOf", _all(bad["anyOf"]))
    if bad["oneOf"]:
        add("oneOf", sum((F.when(b, 0).otherwise(1) for b in bad["oneOf"]), F.lit(0)) != 1)
    if "not" in schema:
        add("not", ~_any(violations(schema["not"], value, kind, path)))
    if "if" in schema:
        met = ~_any(violations(schema["if"], value, kind, path))
        for keyword, when in (("then", met), ("else", ~met)):
            for at, key, wrong in violations(schema.get(keyword, {}), value, kind, path):
                found.append((at, key, when & wrong))
    return found


def _item_violation(schema: dict, kind: T.DataType, path: str):
    def bad(x: Column) -> Column:
        return _any(violations(schema, x, kind, path))

    return bad


def _any(parts: list) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | (p[2] if isinstance(p, tuple) else p)
    return out


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def schema_findings(rows: DataFrame, schema: dict, label: Column) -> DataFrame:
    """(label, path, keyword): a row for each violated keyword; one pass over the rows."""
    row = F.struct(*rows.columns)
    hits = [F.when(bad, F.struct(F.lit(at).alias("path"), F.lit(key).alias("keyword"))) for at, key, bad in violations(schema, row, rows.schema)]
    if not hits:
        return rows.limit(0).select(label.alias("label"), F.lit("").alias("path"), F.lit("").alias("keyword"))
    return rows.select(label.alias("label"), F.explode(F.array_compact(F.array(*hits))).alias("x")).select("label", "x.path", "x.keyword")
