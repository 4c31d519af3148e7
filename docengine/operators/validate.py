"""JSON Schema rules as Columns: validation, defaults, final fields, migrations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": (T.StringType,),
    "number": (T.NumericType,),
    "integer": (T.IntegralType,),
    "boolean": (T.BooleanType,),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
    "null": (T.NullType,),
}
Rule = tuple[str, Column, str]


def _fits(kind: T.DataType, names: list[str]) -> bool:
    return any(isinstance(kind, _KINDS[n]) for n in names if n in _KINDS)


def _field_rules(path: str, c: Column, kind: T.DataType | None, spec: dict[str, Any], deep: bool) -> list[Rule]:
    """(path, broken, message) of one property."""
    names = spec.get("type")
    names = [names] if isinstance(names, str) else list(names or [])
    rules: list[Rule] = []
    if kind is None:
        return rules
    if names and not _fits(kind, names):
        whole = F.lit(False)
        if "integer" in names and isinstance(kind, T.NumericType):
            whole = c == F.floor(c)
        return [(path, c.isNotNull() & ~whole, f"must be {' or '.join(names)}")]
    if len([n for n in names if n != "null"]) > 1 and not deep:
        return rules
    add = lambda broken, message: rules.append((path, c.isNotNull() & broken, message))
    if isinstance(kind, T.StringType):
        size = F.octet_length(c)
        if "minLength" in spec:
            add(size < spec["minLength"], f"shorter than {spec['minLength']}")
        if "maxLength" in spec:
            add(size > spec["maxLength"], f"longer than {spec['maxLength']}")
        if "pattern" in spec:
            add(~c.rlike(spec["pattern"]), f"does not match {spec['pattern']}")
    if isinstance(kind, T.NumericType):
        if "minimum" in spec:
            add(c < spec["minimum"], f"less than {spec['minimum']}")
        if "maximum" in spec:
            add(c > spec["maximum"], f"greater than {spec['maximum']}")
    if isinstance(kind, T.ArrayType):
        if "minItems" in spec:
            add(F.size(c) < spec["minItems"], f"fewer than {spec['minItems']} items")
        if "maxItems" in spec:
            add(F.size(c) > spec["maxItems"], f"more than {spec['maxItems']} items")
        if isinstance(spec.get("items"), dict):
            inner = kind.elementType
            broken = lambda x: _any([r[1] for r in _field_rules(path, x, inner, spec["items"], deep)])
            add(F.coalesce(F.exists(c, broken), F.lit(False)), "an item does not fit")
    if isinstance(kind, T.StructType):
        for name, own in (spec.get("properties") or {}).items():
            inner = kind[name].dataType if name in kind.names else None
            rules += _field_rules(f"{path}.{name}", c[name] if inner is not None else c, inner, own, deep)
    return rules


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def rules(df: DataFrame, schema: dict[str, Any], deep: bool = True) -> list[Rule]:
    out: list[Rule] = []
    for name in schema.get("required", []):
        out.append((name, F.col(name).isNull() if name in df.columns else F.lit(True), "is required"))
    for name, spec in (schema.get("properties") or {}).items():
        kind = df.schema[name].dataType if name in df.columns else None
        out += _field_rules(name, F.col(name) if kind is not None else F.lit(None), kind, spec, deep)
    return out


def is_valid(df: DataFrame, schema: dict[str, Any]) -> Column:
    """Whether a document breaks no rule; a union of types has no other rules."""
    return ~_any([broken for _, broken, _ in rules(df, schema, deep=False)])


def errors(df: DataFrame, schema: dict[str, Any], keep: list[str]) -> DataFrame:
    """One row for each broken rule: the kept columns, path and message."""
    found = [F.when(broken, F.struct(F.lit(p).alias("path"), F.lit(m).alias("message"))) for p, broken, m in rules(df, schema)]
    if not found:
        return df.select(*keep, F.lit("").alias("path"), F.lit("").alias("message")).limit(0)
    return df.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("e")).select(*keep, "e.path", "e.message")


def apply_defaults(df: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """Top-level defaults where a field is missing."""
    for name, spec in (schema.get("properties") or {}).items():
        if "default" in spec:
            value = F.lit(spec["default"])
            df = df.withColumn(name, F.coalesce(F.col(name), value.cast(df.schema[name].dataType)) if name in df.columns else value)
    return df


def final_violations(old: DataFrame, new: DataFrame, schema: dict[str, Any], pk: list[str]) -> DataFrame:
    """(pk, field) of final fields that a new version changes or drops."""
    names = [n for n, s in (schema.get("properties") or {}).items() if s.get("final")]
    renamed = new.select(*pk, *[(F.col(n) if n in new.columns else F.lit(None)).alias(f"_n_{n}") for n in names])
    both = old.join(renamed, pk)
    changed = [F.when(F.col(n).isNotNull() & ~F.col(n).eqNullSafe(F.col(f"_n_{n}")), F.lit(n)) for n in names]
    fields = F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>")
    return both.select(*pk, F.explode(fields).alias("field"))


def migrate(df: DataFrame, steps: dict[int, Callable[[DataFrame], DataFrame]], stored: int, target: int) -> DataFrame:
    """The steps of the versions after ``stored`` up to ``target``, in order; versions without one are skipped."""
    for version in range(stored + 1, target + 1):
        if version in steps:
            df = steps[version](df)
    return df


def short_key(n: int) -> str:
    """a … z, aa, ab …"""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def field_names(kind: T.DataType) -> set[str]:
    """The names of all fields, those of objects and of arrays of objects too."""
    if isinstance(kind, T.StructType):
        return {f.name for f in kind}.union(*(field_names(f.dataType) for f in kind))
    return field_names(kind.elementType) if isinstance(kind, T.ArrayType) else set()


def key_table(kind: T.DataType, known: dict[str, str] | None = None) -> dict[str, str]:
    """Long to short names: known ones stay, new ones follow in their order."""
    out = dict(known or {})
    for name in sorted(field_names(kind) - out.keys()):
        out[name] = short_key(len(out))
    return out


def _renamed(kind: T.DataType, names: dict[str, str]) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(names.get(f.name, f.name), _renamed(f.dataType, names), f.nullable) for f in kind])
    return T.ArrayType(_renamed(kind.elementType, names), kind.containsNull) if isinstance(kind, T.ArrayType) else kind


def _with_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(_renamed(f.dataType, names)).alias(names.get(f.name, f.name)) for f in df.schema])


def compress_keys(df: DataFrame, known: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Documents with short names on every level, and the table of names."""
    names = key_table(df.schema, known)
    return _with_names(df, names), names


def expand_keys(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return _with_names(df, {v: k for k, v in names.items()})


def _floats(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _floats(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_floats(kind.elementType), kind.containsNull)
    return T.DoubleType() if isinstance(kind, T.IntegralType | T.FloatType) else kind


def cloned(df: DataFrame) -> DataFrame:
    """Documents as a deep clone gives them: every number, on any level, is a double."""
    return df.select(*[F.col(f"`{f.name}`").cast(_floats(f.dataType)).alias(f.name) for f in df.schema])
