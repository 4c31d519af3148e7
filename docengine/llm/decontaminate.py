"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

The test items are the indexed side and every passage of every document is a
query. Impacts are divided by the item's score for its own text, so that a
passage scores 1 for an item that it holds whole and one threshold serves all
items. For each passage:

1. *Pivot test.* The largest impacts of its terms are added up; below the
   threshold no item can reach it.
2. *Block maxima.* Items are cut into blocks that all postings share; the terms' largest
   impacts in each block are added up, and blocks below the threshold are skipped.
3. *Cursors.* In a block that is left each term has a cursor on its postings. Cursors are
   kept in the order of their items, their bounds are the terms' maxima in the block, and the item
   at which these reach the threshold is the pivot: cursors before it jump there, and an
   item is scored only when all that may add to it stand on it.

No top-k is cut: every item above the threshold is returned. Each hit is then
verified: enough of the five-word shingles of the item's first half (the question)
and of its second half (the answer) must stand in the passage.

Items are indexed by classes of length: those of up to 64 words are searched for in passages
of 128 words, those of up to 128 in passages of 256, and so on, each passage
beginning half a passage behind the one before. So what is found of an item depends on no
other but by the statistics of BM25. Items go to the tasks in blocks of at most ``block_items``, a
bounded broadcast that is freed when the block is done; more items make more passes over the
documents. Documents are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docengine.llm.common import keyed, load, ship_code, text_bytes, written

NAME = "op3_decontaminate"
K1 = 1.2
B = 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 4
BLOCK_ITEMS = 20_000
ITEM_WORDS = 64
_PUNCTUATION = bytes(ord(" ") if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or i < 32 or i == 127 else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; punctuation of ASCII counts as white space."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PUNCTUATION).split()


class Index:
    """Postings with block maxima, and the shingles of each item's two halves."""

    def __init__(self, items: list[tuple[int, bytes]], stats: tuple[int, float, dict[bytes, int]]):
        n, mean, df = stats
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.term = {w: k for k, w in enumerate(sorted({w for own in words for w in own}))}
        rows, terms, impacts = [], [], []
        for k, own in enumerate(words):
            counts: dict[bytes, int] = {}
            for w in own:
                counts[w] = counts.get(w, 0) + 1
            score = {
                w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(own) / mean))
                for w, c in counts.items()
            }
            total = sum(score.values())
            for w, s in score.items():
                rows.append(k)
                terms.append(self.term[w])
                impacts.append(s / total)
        order = np.lexsort((rows, terms))
        self.items = np.array(rows, dtype=np.int64)[order]
        self.impacts = np.array(impacts)[order]
        own_terms = np.array(terms, dtype=np.int64)[order]
        self.starts = np.searchsorted(own_terms, np.arange(len(self.term) + 1))
        self.most = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(rows) else np.zeros(0)
        self.n_blocks = -(-len(items) // BLOCK)
        key = own_terms * max(self.n_blocks, 1) + self.items // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block_of = (key[first] % max(self.n_blocks, 1)) if len(key) else first
        self.block_most = np.maximum.reduceat(self.impacts, first) if len(key) else np.zeros(0)
        self.block_starts = np.searchsorted(own_terms[first] if len(key) else first, np.arange(len(self.term) + 1))
        self.halves = []
        for own in words:
            middle = len(own) // 2
            self.halves.append(tuple(_shingles(x) for x in (own[:middle], own[middle:])))
        self.key = own_terms * max(len(items), 1) + self.items

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items at or above the threshold, for distinct terms."""
        blocks = _ranges(self.block_starts[terms], self.block_starts[terms + 1])
        bounds = np.bincount(self.block_of[blocks], self.block_most[blocks], minlength=self.n_blocks)
        open_blocks = bounds >= threshold - 1e-9
        if not open_blocks.any():
            return []
        return [x for block in np.flatnonzero(open_blocks).tolist() for x in self._walk(terms, block, threshold - 1e-9)]

    def _walk(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of a block's items at or above the threshold: cursors on postings, led by the pivot."""
        n = len(self.ids)
        lo = np.searchsorted(self.key, terms * n + block * BLOCK)
        hi = np.searchsorted(self.key, terms * n + min((block + 1) * BLOCK, n))
        cursors = []
        for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
            items, impacts = self.items[a:b].tolist(), self.impacts[a:b].tolist()
            cursors.append([items[0], max(impacts), 0, items, impacts])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[1]
                if bound >= threshold:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                here = [c for c in cursors if c[0] == pivot]
                score = sum(c[4][c[2]] for c in here)
                if score >= threshold:
                    out.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            for c in cursors:
                if c[0] < to:
                    c[2] = bisect_left(c[3], to, c[2])
                    c[0] = c[3][c[2]] if c[2] < len(c[3]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _share(half: set, words: list[bytes]) -> float:
    if not half:
        return 1.0
    n = len(next(iter(half)))
    return len(half & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) / len(half)


def find(words: list[bytes], index: Index, threshold: float, overlap: float, width: int) -> dict[int, tuple[float, float, float]]:
    """item -> (score, question overlap, answer overlap) of a document's verified hits."""
    get = index.term.get
    terms = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
    known = np.flatnonzero(terms >= 0)
    found: dict[int, tuple[float, float, float]] = {}
    if not len(known):
        return found
    step = width // 2
    reach = np.concatenate([[0.0], np.cumsum(index.most[terms[known]])])
    starts = np.arange(0, max(len(words) - step, 1), step)
    lo, hi = np.searchsorted(known, starts), np.searchsorted(known, starts + width)
    for k in np.flatnonzero(reach[hi] - reach[lo] >= threshold - 1e-9):
        own = np.unique(terms[known[lo[k] : hi[k]]])
        if index.most[own].sum() < threshold - 1e-9:
            continue
        for item, score in index.search(own, threshold):
            # a passage's neighbours are read too, as an item may lie over its edge
            near = words[max(0, starts[k] - step) : starts[k] + width + step]
            question, answer = (_share(h, near) for h in index.halves[item])
            if question >= overlap and answer >= overlap and (item not in found or found[item][0] < score):
                found[item] = (score, question, answer)
    return found


def _scan(batches: Iterator[pa.RecordBatch], index: Index, threshold: float, overlap: float, width: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
            for item, (score, q, a) in find(words_of(text), index, threshold, overlap, width).items():
                out.append((doc_id, index.ids[item], score, q, a))
        kinds = (batch.schema.field("doc_id").type, kind, pa.float64(), pa.float64(), pa.float64())
        columns = [pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [[w.decode() for w in words_of(t)] for t in text_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, type=pa.list_(pa.string()))], ["item_id", "text", "words"])


def matches(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Defined cases: null and empty texts hold nothing and items without words are
    held by nothing; repeated items are one item each; repeated documents give
    repeated rows; null ids are ids; empty tables give an empty result. Only doc_id, item_id and
    the texts are read; ids may be of any type.
    """
    spark = docs.sparkSession
    ship_code(spark)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text")
    kind = dict(items.dtypes)["item_id"]
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {kind}, score double, question_overlap double, answer_overlap double"
    items = items.mapInArrow(_with_words, f"item_id {kind}, text string, words array<string>").filter("size(words) > 0")
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.size("words") / F.lit(float(ITEM_WORDS)))).cast("int"))
    items = written(items.withColumn("class", size), "benchmark-items")
    n_items, mean = items.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    df = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    classes = sorted((r[0], r[1]) for r in items.groupBy("class").count().collect())  # a number each
    blocks = [(c, k, -(-n // block_items)) for c, n in classes for k in range(-(-n // block_items))]
    out = None
    for c, k, n_blocks in blocks:
        part = items.filter((F.col("class") == c) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k))
        own = [(r[0], r[1].encode()) for r in part.select("item_id", "text").collect()]  # about block_items
        mine = part.select(F.explode("words").alias("word")).distinct()
        counts = {r[0].encode(): r[1] for r in df.join(mine, "word").collect()}  # of the words of these items only
        index = spark.sparkContext.broadcast(Index(own, (n_items, mean, counts)))

        def scan(batches: Iterator[pa.RecordBatch], index=index, width=2 * ITEM_WORDS << c) -> Iterator[pa.RecordBatch]:
            return _scan(batches, index.value, threshold, overlap, width, to_arrow_type(item_type))

        item_type = items.schema["item_id"].dataType
        found = rows.mapInArrow(scan, schema)
        if len(blocks) > 1:
            found = written(found, "benchmark-matches")
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their own columns.

    Defined cases: rows are judged by their own texts, so of rows with one doc_id or
    with a null one each goes or stays by itself; null and empty texts stay; an empty benchmark drops
    nothing; columns of any name pass through.
    """
    rows, key = keyed(docs)
    held = matches(rows.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(written(held, "contaminated"), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE_SQL = None
