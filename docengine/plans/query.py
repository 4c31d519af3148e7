"""The query builder. A Query is immutable and lazy; ``exec`` gives its DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.mango import compile_selector


@dataclass(frozen=True)
class Query:
    df: DataFrame
    selector: dict[str, Any]
    pk: str | None = None
    orders: tuple[tuple[str, bool], ...] = ()
    offset: int = 0
    top: int = -1
    strict: bool = False
    variant: str | None = None

    def _set(self, name: str, op: str | None, value: Any) -> Query:
        """An operator joins others of its field; ``equals`` replaces them, and is replaced by them."""
        old = self.selector.get(name)
        new = value if op is None else {**(old if isinstance(old, dict) else {}), op: value}
        return replace(self, selector={**self.selector, name: new})

    def where(self, name: str) -> Query:
        """Adds no condition; conditions name their field themselves."""
        return self

    def equals(self, name: str, v: Any) -> Query:
        return self._set(name, None, v)

    def gt(self, name: str, v: Any) -> Query:
        return self._set(name, "$gt", v)

    def gte(self, name: str, v: Any) -> Query:
        return self._set(name, "$gte", v)

    def lt(self, name: str, v: Any) -> Query:
        return self._set(name, "$lt", v)

    def lte(self, name: str, v: Any) -> Query:
        return self._set(name, "$lte", v)

    def is_in(self, name: str, values: list) -> Query:
        return self._set(name, "$in", values)

    def nin(self, name: str, values: list) -> Query:
        return self._set(name, "$nin", values)

    def exists(self, name: str, v: bool = True) -> Query:
        return self._set(name, "$exists", v)

    def type(self, name: str, v: str) -> Query:
        return self._set(name, "$type", v)

    def regex(self, name: str, pattern: str) -> Query:
        return self._set(name, "$regex", pattern)

    def any_of(self, parts: list[dict]) -> Query:
        return replace(self, selector={**self.selector, "$or": parts})

    def all_of(self, parts: list[dict]) -> Query:
        return replace(self, selector={**self.selector, "$and": parts})

    def none_of(self, part: dict) -> Query:
        return replace(self, selector={**self.selector, "$not": part})

    def sort(self, keys: dict[str, str]) -> Query:
        """Several keys in the dictionary's own order; 'desc' descends."""
        return replace(self, orders=tuple((k, v == "desc") for k, v in keys.items()))

    def order_by(self, name: str, desc: bool = False) -> Query:
        return replace(self, orders=(*self.orders, (name, desc)))

    def skip(self, n: int) -> Query:
        return replace(self, offset=max(n, 0))

    def limit(self, n: int) -> Query:
        return replace(self, top=n)

    def matches(self) -> Column:
        return compile_selector(self.df, self.selector, self.strict, self.variant)

    def exec(self) -> DataFrame:
        """Filter, sort (nulls lowest, then the primary key), skip, limit; planned as a top-k where limited."""
        out = self.df.filter(self.matches()) if self.selector else self.df
        if self.orders:
            keys = [F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, d in self.orders]
            if self.pk and self.pk not in dict(self.orders):
                keys.append(F.col(self.pk).asc())
            out = out.orderBy(*keys)
        if self.offset:
            out = out.offset(self.offset)
        return out.limit(self.top) if self.top >= 0 else out

    def select(self, *columns: str) -> DataFrame:
        return self.exec().select(*columns)

    def find_one(self) -> Row | None:
        return self.limit(1).exec().first()

    def count(self) -> int:
        """Of all matches: sorting and paging do not count."""
        return self.df.filter(self.matches()).count()

    def counted(self) -> DataFrame:
        return self.df.filter(self.matches()).agg(F.count("*").alias("n"))

    def update(self, values: dict[str, Any]) -> DataFrame:
        """The whole table with the matches' fields set; the primary key is left as it is."""
        hit = self.matches()
        out = self.df
        new = {k: F.when(hit, F.lit(v)).otherwise(F.col(k)) if k in out.columns else F.when(hit, F.lit(v)) for k, v in values.items() if k != self.pk}
        return out.withColumns(new)

    def remove(self) -> DataFrame:
        """The table without the matches."""
        return self.df.filter(~self.matches())

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return self.exec().transform(f)


def find(df: DataFrame, selector: dict | None = None, pk: str | None = None, **more: Any) -> Query:
    return Query(df, selector or {}, pk, **more)


def get_string(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if isinstance(df.schema[name].dataType, T.StringType) else F.lit("")


def get_int(df: DataFrame, name: str) -> Column:
    """Truncated; zero where the field is no number."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0)) if isinstance(df.schema[name].dataType, T.NumericType) else F.lit(0).cast("bigint")


def get_float(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if isinstance(df.schema[name].dataType, T.NumericType) else F.lit(0.0)


def get_bool(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if isinstance(df.schema[name].dataType, T.BooleanType) else F.lit(False)


def get_array(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array()) if isinstance(df.schema[name].dataType, T.ArrayType) else F.array()


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("json"))
