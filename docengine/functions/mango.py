"""Selectors: a dictionary of conditions becomes one Column that is never NULL.

Conditions are two-valued: a missing or null operand gives false (true under a
negation). Comparisons are written as ``IS NOT NULL AND c > v`` and ``<=>``, never
as ``coalesce``, so that they are pushed down to the files. There are no implicit
casts: a literal that does not fit the field's type gives a constant. Fields are
columns, fields of structs (dotted paths) or paths in a VARIANT column.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRUE, FALSE = True, False
_NO_RE2 = re.compile(r"\(\?(=|!|<=|<!|>)|\\[1-9]|([*+?]|\{\d+(,\d*)?\})\+")


def both(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _is_number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


class Missing:
    """A field that no document has."""

    array: Leaf | None = None

    def value(self, v: Any) -> Column | None:
        return None

    def null(self) -> Column:
        return F.lit(True)

    def present(self) -> Column:
        return F.lit(False)

    def is_type(self, name: str) -> Column:
        return F.lit(name == "null")

    def text(self) -> Column | None:
        return None

    def integer(self) -> Column:
        return F.lit(0)

    def elements(self) -> tuple[Column, Any] | None:
        return None


@dataclass
class Leaf(Missing):
    """A typed field."""

    column: Column
    kind: T.DataType

    def value(self, v: Any) -> Column | None:
        """The field as something that compares with ``v``, null where it does not; None if it never does."""
        k = self.kind
        fits = (
            (isinstance(v, bool) and isinstance(k, T.BooleanType))
            or (_is_number(v) and isinstance(k, T.NumericType))
            or (isinstance(v, str) and isinstance(k, T.StringType))
            or (isinstance(v, list) and isinstance(k, T.ArrayType))
            or (isinstance(v, datetime.date) and isinstance(k, T.DateType | T.TimestampType | T.TimestampNTZType))
        )
        return self.column if fits else None

    def null(self) -> Column:
        return self.column.isNull()

    def present(self) -> Column:
        return self.column.isNotNull()

    def is_type(self, name: str) -> Column:
        kinds = {"string": T.StringType, "number": T.NumericType, "boolean": T.BooleanType, "array": T.ArrayType, "object": (T.StructType, T.MapType)}
        if name == "null":
            return self.null()
        return self.present() if name in kinds and isinstance(self.kind, kinds[name]) else F.lit(False)

    def text(self) -> Column | None:
        return self.column if isinstance(self.kind, T.StringType) else None

    def integer(self) -> Column:
        if isinstance(self.kind, T.NumericType):
            return F.coalesce(self.column.cast("bigint"), F.lit(0))
        return F.lit(0)

    def elements(self) -> tuple[Column, Any] | None:
        if not isinstance(self.kind, T.ArrayType):
            return None
        inner = self.kind.elementType
        return self.column, lambda x: Scope.of(x, inner)


@dataclass
class VariantLeaf(Missing):
    """A path in a VARIANT; every extraction is guarded by the stored type."""

    column: Column

    def _stored(self, *prefixes: str) -> Column:
        kind = F.schema_of_variant(self.column)
        return either([kind.startswith(p) for p in prefixes])

    def _guarded(self, out: str, *prefixes: str) -> Column:
        return F.when(self._stored(*prefixes), F.try_variant_get(self.column, "$", out))

    def value(self, v: Any) -> Column | None:
        if isinstance(v, bool):
            return self._guarded("boolean", "BOOLEAN")
        if _is_number(v):
            return self._guarded("double", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
        if isinstance(v, str):
            return self._guarded("string", "STRING")
        return None

    def null(self) -> Column:
        return self.column.isNull() | F.coalesce(F.is_variant_null(self.column), F.lit(False))

    def present(self) -> Column:
        return self.column.isNotNull()

    def is_type(self, name: str) -> Column:
        kinds = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
        if name == "null":
            return self.null()
        return F.coalesce(self._stored(*kinds[name]), F.lit(False)) if name in kinds else F.lit(False)

    def text(self) -> Column | None:
        return self.value("")

    def integer(self) -> Column:
        return F.coalesce(self.value(0).cast("bigint"), F.lit(0))

    def elements(self) -> tuple[Column, Any] | None:
        return F.when(self._stored("ARRAY"), self.column).cast("array<variant>"), lambda x: VariantScope(x)


@dataclass
class Scope:
    """Where the names of a selector are looked up: columns of a table or fields of a struct."""

    fields: dict[str, Leaf]
    is_object: bool = True
    itself: Missing = field(default_factory=Missing)

    @staticmethod
    def of_table(df: DataFrame) -> Scope:
        return Scope({f.name: Leaf(F.col(f"`{f.name}`"), f.dataType) for f in df.schema})

    @staticmethod
    def of(column: Column, kind: T.DataType) -> Scope | VariantScope:
        if isinstance(kind, T.VariantType):
            return VariantScope(column)
        own = {f.name: Leaf(column[f.name], f.dataType) for f in kind} if isinstance(kind, T.StructType) else {}
        return Scope(own, isinstance(kind, T.StructType | T.MapType), Leaf(column, kind))

    def leaf(self, path: str) -> Missing:
        if path in self.fields:
            found = self.fields[path]
            return VariantLeaf(found.column) if isinstance(found.kind, T.VariantType) else found
        head, _, rest = path.partition(".")
        if not rest or head not in self.fields:
            return Missing()
        own = self.fields[head]
        if isinstance(own.kind, T.MapType):
            return Leaf(F.try_element_at(own.column, F.lit(rest)), own.kind.valueType)
        return Scope.of(own.column, own.kind).leaf(rest)

    def objects_only(self) -> Column:
        return self.itself.present() if self.is_object else F.lit(False)


@dataclass
class VariantScope:
    """A VARIANT whose members are looked up by path."""

    column: Column

    @property
    def itself(self) -> VariantLeaf:
        return VariantLeaf(self.column)

    def leaf(self, path: str) -> VariantLeaf:
        steps = "".join(f"['{p}']" for p in path.split("."))
        return VariantLeaf(F.try_variant_get(self.column, "$" + steps, "variant"))

    def objects_only(self) -> Column:
        return self.itself.is_type("object")


def _literal(v: Any) -> Column:
    return F.array(*[_literal(x) for x in v]) if isinstance(v, list) else F.lit(v)


def equal(leaf: Missing, v: Any) -> Column:
    if v is None:
        return leaf.null()
    column = leaf.value(v)
    if column is None:
        return F.lit(False)
    if isinstance(v, list):
        if not v:
            return leaf.present() & F.coalesce(F.size(column) == 0, F.lit(False))
        return column.eqNullSafe(_literal(v).cast(leaf.kind))
    return column.eqNullSafe(F.lit(v))


def _compare(leaf: Missing, v: Any, op: str) -> Column:
    if isinstance(v, bool) or not isinstance(v, int | float | str | datetime.date):
        return F.lit(False)
    column = leaf.value(v)
    if column is None:
        return F.lit(False)
    return column.isNotNull() & {"gt": column > v, "gte": column >= v, "lt": column < v, "lte": column <= v}[op]


def _one_of(leaf: Missing, values: Any) -> Column:
    if not isinstance(values, list | tuple):
        return F.lit(False)
    groups: dict[type, list] = {}
    parts = []
    for v in values:
        if v is None or isinstance(v, list | dict):
            parts.append(equal(leaf, v) if not isinstance(v, dict) else F.lit(False))
        else:
            groups.setdefault(float if _is_number(v) else type(v), []).append(v)
    for own in groups.values():
        column = leaf.value(own[0])
        if column is not None:
            parts.append(column.isNotNull() & column.isin(own))
    return either(parts)


def _regex(leaf: Missing, pattern: Any) -> Column:
    column = leaf.text()
    if column is None or not isinstance(pattern, str) or _NO_RE2.search(pattern):
        return F.lit(False)
    pattern = java_pattern(pattern)
    return column.isNotNull() & column.rlike(pattern) if _compiles(pattern) else F.lit(False)


#: Names of scripts that the JVM wants to be marked as such.
_SCRIPTS = "Arabic Armenian Bengali Cyrillic Devanagari Georgian Greek Gujarati Han Hangul Hebrew Hiragana Katakana Khmer Lao Latin Mongolian Myanmar Tamil Telugu Thai Tibetan"


def java_pattern(pattern: str) -> str:
    """A pattern in the JVM's spelling: named groups, scripts and bracketed classes."""
    pattern = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)
    pattern = re.sub(r"\\([pP])\{(\^?)(%s)\}" % "|".join(_SCRIPTS.split()), lambda m: f"\\{m[1] if not m[2] else 'P' if m[1] == 'p' else 'p'}{{Is{m[3]}}}", pattern)
    named = lambda m: f"\\{'P' if m[1] else 'p'}{{{'IsWord' if m[2] == 'word' else 'XDigit' if m[2] == 'xdigit' else m[2].upper() if m[2] == 'ascii' else m[2].capitalize()}}}"
    pattern = re.sub(r"\[:(\^?)(alnum|alpha|ascii|blank|cntrl|digit|graph|lower|print|punct|space|upper|xdigit):\]", named, pattern)
    return re.sub(r"\[:(\^?)word:\]", lambda m: r"\W" if m[1] else r"\w", pattern)


def _compiles(pattern: str) -> bool:
    """Whether the JVM, which will match it, takes the pattern."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def _elem_match(leaf: Missing, sub: Any) -> Column:
    found = leaf.elements()
    if found is None or not isinstance(sub, dict):
        return F.lit(False)
    column, scope = found

    def test(x: Column) -> Column:
        own = scope(x)
        return F.coalesce(own.objects_only() & selector_in(own, sub), F.lit(False))

    return column.isNotNull() & F.coalesce(F.exists(column, test), F.lit(False))


def _all(leaf: Missing, values: Any) -> Column:
    found = leaf.elements()
    if found is None or not isinstance(values, list):
        return F.lit(False)
    column, scope = found

    def has(v: Any) -> Column:
        return F.coalesce(F.exists(column, lambda x: equal(scope(x).itself, v)), F.lit(False))

    return both([column.isNotNull(), *map(has, values)])


def _size(leaf: Missing, n: Any) -> Column:
    found = leaf.elements()
    if found is None or not _is_number(n):
        return F.lit(False)
    return found[0].isNotNull() & (F.size(found[0]) == int(n))


def _mod(leaf: Missing, operand: Any) -> Column:
    if not isinstance(operand, list | tuple) or len(operand) != 2 or not all(map(_is_number, operand)) or not int(operand[0]):
        return F.lit(False)
    return leaf.integer() % F.lit(int(operand[0])) == F.lit(int(operand[1]))


OPERATORS = {
    "$eq": equal,
    "$ne": lambda leaf, v: ~equal(leaf, v),
    "$gt": lambda leaf, v: _compare(leaf, v, "gt"),
    "$gte": lambda leaf, v: leaf.null() if v is None else _compare(leaf, v, "gte") if not isinstance(v, bool | list) else equal(leaf, v),
    "$lt": lambda leaf, v: _compare(leaf, v, "lt"),
    "$lte": lambda leaf, v: leaf.null() if v is None else _compare(leaf, v, "lte") if not isinstance(v, bool | list) else equal(leaf, v),
    "$in": _one_of,
    "$nin": lambda leaf, v: ~_one_of(leaf, v),
    "$exists": lambda leaf, v: ~leaf.present() if v is False else leaf.present(),
    "$type": lambda leaf, v: leaf.is_type(v) if isinstance(v, str) else F.lit(False),
    "$regex": _regex,
    "$elemMatch": _elem_match,
    "$size": _size,
    "$all": _all,
    "$mod": _mod,
}


class UnknownOperator(ValueError):
    """Raised in strict mode only; otherwise an unknown operator matches nothing."""


def selector_in(scope: Any, selector: dict | None, strict: bool = False) -> Column:
    """A selector over the names of a scope."""
    parts = []
    for key, value in (selector or {}).items():
        if key in ("$and", "$or", "$nor"):
            subs = [selector_in(scope, s, strict) for s in (value if isinstance(value, list | tuple) else []) if isinstance(s, dict)]
            parts.append({"$and": both, "$or": either, "$nor": lambda x: ~either(x)}[key](subs))
        elif key == "$not":
            parts.append(~selector_in(scope, value, strict) if isinstance(value, dict) else F.lit(False))
        elif isinstance(value, dict):
            leaf = scope.leaf(key)
            for op, operand in value.items():
                if op in OPERATORS:
                    parts.append(OPERATORS[op](leaf, operand))
                elif strict:
                    raise UnknownOperator(op)
                else:
                    parts.append(F.lit(False))
        else:
            parts.append(equal(scope.leaf(key), value))
    return both(parts)


def compile_selector(df: DataFrame, selector: dict | None, strict: bool = False, variant: str | None = None) -> Column:
    """A selector over the columns of ``df``, or over the members of its VARIANT column ``variant``."""
    scope = VariantScope(F.col(f"`{variant}`")) if variant else Scope.of_table(df)
    return selector_in(scope, selector, strict)
