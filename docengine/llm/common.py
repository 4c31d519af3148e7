"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.session import discard, ship_code, shared_dir, written

__all__ = ["crc32_joined", "crc32_of_id", "discard", "give_back", "key_filter", "keyed", "load", "may_hold", "null_safe", "ship_code", "shared_dir", "text_bytes", "written"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id written as text; folds of labels are cut by it."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, and that column's name.

    It is doc_id's value where that is never null or repeated. Otherwise rows are numbered,
    and written so that the numbers stay.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    odd = docs.select("doc_id").groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1)
    if odd.first() is None:
        return docs.withColumn(key, F.col("doc_id")), key
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed-rows"), key


def null_safe(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """A join condition on ``names`` under which null equals null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def text_bytes(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The column's values as UTF-8 bytes, one at a time; null is empty."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def give_back() -> None:
    """Free what Arrow's pool keeps unused; an idle worker would hold it beside the other workers and the JVM."""
    pa.default_memory_pool().release_unused()


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32, lowest power in the highest bit."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_joined(first: int, second: int, n: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the length of the second."""
    power, square = 1 << 31, 1 << 23  # one, and the eighth power of x: one byte
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, first) ^ second


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _slots_of(batches: Iterator[pa.RecordBatch], bits: int, read: Callable[[pa.Array], np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        slot = _slot(read(column) if read else column.to_numpy(zero_copy_only=False), bits)
        yield pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], ["at", "bit"])


def key_filter(keys: DataFrame, read: Callable[[pa.Array], np.ndarray] | None = None):
    """A broadcast of bits, sixteen for each key and 2^28 (32 MB) at most, with those of the keys (one long column, or one that ``read`` makes long) set.

    It saves work alone: an exact join follows.
    """
    bits = min(max((16 * keys.count()).bit_length(), 12), 28)
    words = keys.mapInArrow(partial(_slots_of, bits=bits, read=read), "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    words = words.toArrow()
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast((bits, out))


def may_hold(shared: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the filter's."""
    bits, words = shared
    slot = _slot(keys, bits)
    return (words[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
