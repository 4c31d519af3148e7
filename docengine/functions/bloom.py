"""Bloom filters of a column, built by Spark's own sketch: filled in the tasks and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Bloom:
    """Whether a value may be in a column. The size is set by the expected number and the share of false answers."""

    def __init__(self, sketch):
        self._sketch = sketch

    @classmethod
    def of(cls, df: DataFrame, column: str, expected: int, share: float = 0.01) -> Bloom:
        kind = "string" if dict(df.dtypes)[column] == "string" else "long"
        rows = df.select(df[column].cast(kind).alias("v")).filter("v is not null")
        return cls(rows._jdf.stat().bloomFilter("v", max(expected, 1), share))

    def might_contain(self, value: object) -> bool:
        return bool(self._sketch.mightContainString(value) if isinstance(value, str) else self._sketch.mightContainLong(int(value)))

    def merged(self, other: Bloom) -> Bloom:
        """Of both columns; the filters must have been built alike."""
        self._sketch.mergeInPlace(other._sketch)
        return self

    @property
    def bits(self) -> int:
        return int(self._sketch.bitSize())
