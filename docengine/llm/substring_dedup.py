"""Removal of repeated byte strings by distributed prefix doubling over sampled places.

A place's name at a length stands for the bytes from there; names at a longer
length are made of two names at offsets, and places whose name is unique are
dropped from the next round. The rounds are

1. ``GRAM`` bytes, doubled within a task. Not every place takes part but each
   window's anchor: the place of its gram with the smallest name. Windows of equal
   bytes have anchors at equal offsets, so none is missed, and there is one anchor
   for some thirty bytes. Spark counts the names; unique ones are dropped.
2. The *region* of an anchor: all windows that have it. Spark finds the earliest
   member of each (gram, region). Every later member is repeated as a whole.
3. ``LENGTH`` bytes, the threshold: only for the earliest members of grams that
   have several regions, which is where repeated strings begin and end. Spark
   finds the earliest place of each window.

Ranks are names rather than dense numbers: a rank by sorting costs a shuffle of
one row per byte and round, over sixteen times the input a round, where names
cost none and let unique places go at once. Regions of one gram are told apart by the
128 bits of their own digest beside the gram's 64, windows in round 3 by 96 bits; no bytes are
compared after that. Of k regions of one gram, k * k / 2^129 pairs are expected to be taken for
each other, even if all their grams were one. A place is one integer: the document's number, then the byte.

Skew: counts and earliest places are pre-aggregated. What is joined back is joined
from written tables, so a hot gram is a skewed join that Spark splits. Only a
document's own spans are gathered in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import discard, load, ship_code, text_bytes, written

NAME = "op10_substring_dedup"
LENGTH = 100
GRAM = 40
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def names(data: np.ndarray, length: int, salt: int = 1) -> np.ndarray:
    """A 64-bit name of the ``length`` bytes from each place, by doubling.

    The name of twice as many bytes is made of the names of the two halves. A
    length that is no power of two takes two overlapping halves at the end.
    """
    own, n = (data.astype(np.uint64) + np.uint64(salt)) * _ODD, 1
    own ^= own >> np.uint64(29)
    while n < length:
        step = min(n, length - n)
        own = own[:-step] * _MIX + (own[step:] ^ (own[step:] >> np.uint64(31))) * _ODD
        own ^= own >> np.uint64(30)
        n += step
    return own


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(name of the anchor's gram, first window, last window) for runs of windows with one anchor.

    A window's anchor is the place of its gram with the smallest name, the first
    of equals, so windows of equal bytes have anchors at equal places.
    """
    count = len(data) - length + 1
    if count < 1:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    name = names(data, gram)
    least = (name & ~np.uint64((1 << 24) - 1)) | np.arange(len(name), dtype=np.uint64)
    width, n = length - gram + 1, 1
    while n < width:
        step = min(n, width - n)
        least = np.minimum(least[:-step], least[step:])
        n += step
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], count] - 1
    return name[at[first]].view(np.int64), first, last


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, bits: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16())

    def out(held: list) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(x), type=t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["g", "r", "q", "place", "n"])

    for batch in batches:
        held, n = [], 0
        for doc, text in zip(batch.column("doc").to_pylist(), text_bytes(batch, "text"), strict=True):
            data = np.frombuffer(text, np.uint8)
            for at in range(0, max(len(text) - length + 1, 0), PIECE):  # windows of a piece, with what they reach into
                g, lo, hi = anchors(data[at : at + PIECE + length - 1], length, gram)
                lo, hi = lo + at, hi + at
                digest = xxhash.xxh3_128_digest
                r = b"".join([digest(text[i : j + length]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)])
                r = np.frombuffer(r, np.int64).reshape(-1, 2)
                held.append((g, r[:, 0], r[:, 1], (doc << bits) + lo, hi - lo))
                n += len(g)
                if n > 200_000:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)


def _spans(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each row's spans as arrays, in the order of their starts."""
    column = batch.column("spans")
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    inner = column.flatten()
    fields = {inner.type.field(i).name: x.to_numpy(zero_copy_only=False) for i, x in enumerate(inner.flatten())}
    start = 0
    for end in ends.tolist():
        own = {k: x[start:end] for k, x in fields.items()}
        order = np.argsort(own["a"], kind="stable")
        yield {k: x[order] for k, x in own.items()}
        start = end


def _window_rows(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(w, v, place) of each window of the spans; the stretches of many spans are named in one go."""
    stretches, starts, places, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        nonlocal stretches, starts, places, size
        data, at, place = map(np.concatenate, (stretches, starts, places))
        one = names(data, length)[at].view(np.int64)
        two = (names(data, length, 77)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        stretches, starts, places, size = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, place)], ["w", "v", "place"])

    for batch in batches:
        for doc, text, own in zip(batch.column("doc").to_pylist(), text_bytes(batch, "text"), _spans(batch), strict=True):
            data = np.frombuffer(text, np.uint8)
            a, b = own["a"].astype(np.int64), own["b"].astype(np.int64)
            if not len(a):
                continue
            # near spans share one stretch of the text, of about a piece at most
            apart = (a[1:] > np.maximum.accumulate(b)[:-1] + length) | (a[1:] // PIECE != a[:-1] // PIECE)
            cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(a)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                low, n = int(a[i]), b[i:j] - a[i:j] + 1
                at = np.repeat(a[i:j] - np.cumsum(n) + n, n) + np.arange(n.sum())
                stretch = data[low : int(b[i:j].max()) + length]
                stretches.append(stretch)
                starts.append(at - low + size)
                places.append((doc << bits) + at)
                size += len(stretch)
                if size >= PIECE // 2:
                    yield out()
    if size:
        yield out()


def removed(n: int, kind: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` bytes go.

    Spans of kind 0 (later members) and 1 (earliest members) are ranges of windows
    from ``a`` to ``b``; those of kind 2 are windows of earliest members that stay.
    """
    ranges = kind < 2
    windows = np.zeros(max(n - length + 1, 0) + 1, dtype=np.int32)
    np.add.at(windows, a[ranges], 1)
    np.subtract.at(windows, b[ranges] + 1, 1)
    marked = np.cumsum(windows)[:-1] > 0
    marked[a[~ranges]] = False
    at = np.flatnonzero(marked)
    cover = np.zeros(n + 1, dtype=np.int32)
    cover[at] += 1
    cover[at + length] -= 1
    return np.cumsum(cover)[:-1] > 0


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), _spans(batch), strict=True):
            kept, gone, n_spans = text, 0, 0
            if len(own["a"]):
                mask = removed(len(text), own["kind"], own["a"], own["b"], length)
                gone = int(mask.sum())
                n_spans = int((mask[1:] & ~mask[:-1]).sum() + mask[0])
                if gone:
                    kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            rows.append((doc_id, len(text), gone, n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)]
        columns[0] = columns[0].cast(batch.schema.field("doc_id").type)
        names_ = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays(columns[: 6 if with_text else 5], names_[: 6 if with_text else 5])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a
    smaller doc_id, or earlier in the same document. Defined cases: a null text is
    empty; texts shorter than ``length`` stay; rows with a null doc_id come before all
    others, and rows with the same doc_id in the order of their texts; an empty
    table gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    docs = docs.select("doc_id", "text")
    repeated = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    low, high, longest = docs.agg(
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("long"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("long"), F.coalesce(F.max(F.octet_length("text")), F.lit(0))
    ).first()
    bits = max(int(longest).bit_length(), 1)
    if repeated or low < 0 or int(high).bit_length() + bits > 62:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
        docs = written(ordered.withColumn("uid", F.monotonically_increasing_id()), "substring-docs")
        inside = F.col("uid").bitwiseAND(F.lit((1 << 33) - 1))
        most = docs.agg(F.coalesce(F.max(inside), F.lit(0))).first()[0]
        part = F.shiftleft(F.shiftright("uid", 33), max(int(most).bit_length(), 1))
        docs = docs.withColumn("doc", part.bitwiseOR(inside)).drop("uid")
    else:
        docs = docs.withColumn("doc", F.col("doc_id").cast("long"))
    plain = docs.select("doc", "text")
    doc = lambda place: F.shiftright(place, bits)
    byte = lambda place: F.col(place).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def span(kind: int, place: str, n: Column) -> tuple[Column, ...]:
        return doc(place).alias("doc"), F.lit(kind).alias("kind"), byte(place).alias("a"), (byte(place) + n).alias("b")

    run = partial(_anchor_rows, length=length, gram=gram, bits=bits)
    rows = written(plain.mapInArrow(run, "g long, r long, q long, place long, n short"), "substring-anchors")
    twice = written(rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "substring-grams")
    same = written(rows.join(twice, "g", "left_semi"), "substring-same")
    discard(rows)
    firsts = same.groupBy("g", "r", "q").agg(F.min("place").alias("first"), F.max("n").alias("width"))
    firsts = written(firsts, "substring-firsts")
    several = written(firsts.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "substring-several")
    reps = written(firsts.join(several, "g", "left_semi").select(*span(1, "first", F.col("width"))), "substring-reps")
    later = same.join(firsts.drop("width"), ["g", "r", "q"]).filter("place > first").select(*span(0, "place", F.col("n")))
    later = written(later, "substring-later")
    discard(same)
    discard(firsts)
    own = reps.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    windows = plain.join(own, "doc").mapInArrow(partial(_window_rows, length=length, bits=bits), "w long, v int, place long")
    earliest = written(windows.groupBy("w", "v").agg(F.min("place").alias("place")).select("place"), "substring-earliest")
    spans = later.unionByName(reps).unionByName(earliest.select(*span(2, "place", F.lit(0))))
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("kind", "a", "b")).alias("spans"))
    kept = ", kept binary" if with_text else ""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}"
    joined = docs.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(partial(_cut, length=length, with_text=with_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


ORACLE_SQL = None
