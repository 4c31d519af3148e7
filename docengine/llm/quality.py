"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The inputs of a text are its distinct words, hashed into ``BUCKETS`` places and
weighted by one over the root of their number, and statistics of its structure
(shares of kinds of characters, lengths of words and lines, repetition) and
metadata that follow from the text (its length, its number of lines), each cut
into bins. A pair of inputs interacts by the inner product of their factors; the
sum over all pairs takes linear time, as half the difference between the square of
the sums and the sum of the squares.

The machine is fitted on the driver by AdaGrad on a bounded sample of labelled
rows: at most ``PER_CLASS`` of each class and ``MAX_CHARS`` characters. It is
applied to every whole text where the text is read; nothing is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import crc32_of_id, give_back, load, ship_code, text_bytes
from docengine.llm.labelled import sample

NAME = "op1_quality"
BUCKETS = 1 << 16
FACTORS = 8
PER_CLASS = 2500
MAX_CHARS = 30_000_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
EPOCHS = 8
RATE = 0.05
DECAY = 1e-4
BINS = 16
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\f\r"
_STOP = b".,;:'\"-()"
_ODD = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOP)
N_STATS = 14


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Numbers between 0 and 1 about structure and size."""
    n = len(text)
    share = lambda kind: (n - len(text.translate(None, kind))) / n if n else 0.0
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    spread = lambda x, top: min(math.log1p(x) / math.log1p(top), 1.0)
    return [
        share(_UPPER),
        share(_LOWER),
        share(_DIGIT),
        share(_SPACE),
        share(_STOP),
        share(_ODD),
        spread(n / max(len(words), 1), 40),
        distinct / max(len(words), 1),
        len(set(lines)) / max(len(lines), 1),
        ends / max(len(lines), 1),
        sum(len(w) > 3 for w in words) / max(len(words), 1),
        spread(n, 1e6),
        spread(len(lines), 1e4),
        spread(len(words) / max(len(lines), 1), 1e3),
    ]


def inputs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's inputs: hashed words, then one bin for each statistic."""
    words = text.split()
    own = set(text.lower().split())
    hashed = np.fromiter((zlib.crc32(w) for w in own), dtype=np.int64, count=len(own)) % BUCKETS
    stats = np.array(statistics(text, words, len(own)))
    bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    places = np.concatenate([hashed, BUCKETS + np.arange(N_STATS) * BINS + bins])
    values = np.concatenate([np.full(len(own), 1 / math.sqrt(max(len(own), 1))), np.full(N_STATS, 1 / math.sqrt(N_STATS))])
    return places, values


class Machine:
    """score = w0 + w.x + sum over pairs of <v_i, v_j> x_i x_j, through the logistic function."""

    def __init__(self, seed: int = 7):
        size = BUCKETS + N_STATS * BINS
        self.bias = 0.0
        self.weights = np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (size, FACTORS))

    def raw(self, places: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[places] * values[:, None]
        sums = v.sum(axis=0)
        return float(self.bias + self.weights[places] @ values + 0.5 * (sums @ sums - (v * v).sum()))

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(*inputs(text))))))

    def fit(self, rows: list[tuple[int, bytes]]) -> Machine:
        """Labels and texts; without both classes the share of label 1 (a half if there are no rows) is the answer."""
        ys = np.array([y for y, _ in rows], dtype=float)
        mean = min(max(ys.mean(), 1e-3), 1 - 1e-3) if len(ys) else 0.5
        self.bias = math.log(mean / (1 - mean))
        if not len(ys) or ys.min() == ys.max():
            self.factors[:] = 0
            return self
        made = [inputs(t) for _, t in rows]
        g_w, g_v, g_b = np.full(len(self.weights), 1e-6), np.full(self.factors.shape, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)):
                places, x = made[k]
                v = self.factors[places]
                sums = x @ v
                z = self.bias + self.weights[places] @ x + 0.5 * (sums @ sums - ((v * x[:, None]) ** 2).sum())
                slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - ys[k]
                g_b += slope * slope
                self.bias -= RATE * slope / math.sqrt(g_b)
                d_w = slope * x + DECAY * self.weights[places]
                d_v = slope * (x[:, None] * (sums - v * x[:, None])) + DECAY * v
                g_w[places] += d_w * d_w
                g_v[places] += d_v * d_v
                self.weights[places] -= RATE * d_w / np.sqrt(g_w[places])
                self.factors[places] -= RATE * d_v / np.sqrt(g_v[places])
        self.weights, self.factors = self.weights.astype(np.float32), self.factors.astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learns from labelled rows outside the held-out fold."""
    learnable = crc32_of_id(F.col("doc_id")) % FOLDS != HELD_OUT
    rows = sample(docs, labels, "quality", learnable, PER_CLASS, MAX_CHARS)
    return Machine().fit([(y, t) for _, y, t in rows])


def scores(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Defined cases: null and empty texts are scored by their structure alone; a
    null doc_id is not held out; repeated rows are scored one by one; an empty table
    gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.score(t) for t in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns.

    The text goes through the scoring step beside the other columns, so nothing
    is joined back.
    """
    spark = docs.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.value.score(t) >= THRESHOLD for t in text_bytes(batch, "text")]
            yield batch.filter(pa.array(good, type=pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scores(docs, fit(docs, load(spark, sf_dir, "labels")))


ORACLE_SQL = None
