"""Toxicity by class-conditional Kneser-Ney models.

One model is made of the toxic and one of the ordinary labelled texts. A model
gives the probability of a word as that of its bytes, one after the other, each
given up to seven bytes before it from the word's start, so it knows expressions
it has seen and words of their families. Counts are of documents that have the
word. Both models take an absolute discount, by which a sequence that a class has
once or twice gives its mass to the backoff, and both back off to the same
continuation counts of shorter contexts (in how many different words of either
class a sequence stands). So a rare expression says little about the class.

A text's evidence is the difference of its two log-likelihoods over its length,
for the whole text and for its most toxic windows of ``WINDOWS`` words, so that a
few words in a long text are seen. A logistic function of these, fitted on texts
that the models had not seen (two halves of the sample, crosswise), gives the
score.

The models are fitted on the driver on a bounded sample: at most ``PER_CLASS``
rows of each class and ``MAX_CHARS`` characters. Every whole text is scored where
it is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import crc32_of_id, load, ship_code, text_bytes
from docengine.llm.decontaminate import words_of
from docengine.llm.labelled import sample

NAME = "op9_toxicity"
PER_CLASS = 2500
MAX_CHARS = 24_000_000
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
WINDOWS = (1, 3)
DISCOUNT = 3.0
SHORT = 3
CACHE_WORDS = 400_000
_START, _END = 0x5E, 0x24


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, their words, places): each byte behind a word's start with up to seven before it, as one integer."""
    data = np.frombuffer(b"".join(b"^%b$" % w for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - starts[owner]
    out = data.copy()
    for k in range(1, 8):
        out[k:] |= np.where(place[k:] >= k, data[:-k], np.uint64(0)) << np.uint64(8 * k)
    inner = place > 0
    return out[inner], owner[inner], place[inner]


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights, minlength=len(found))


def _look(table: np.ndarray, values: np.ndarray, keys: np.ndarray, other: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), other)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], other)


class Models:
    """Log ratios of the two models' probabilities of a byte in its context."""

    def __init__(self, texts: list[tuple[int, list[bytes]]]):
        counts: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for y, words in texts:
            own = counts[y]
            for w in set(words):
                own[w] = own.get(w, 0) + 1
        words = sorted({*counts[0], *counts[1]})
        grams, owner, _ = _grams(words)
        each = [np.array([c.get(w, 0) for w in words], dtype=float) for c in counts]
        # the shared backoff: continuation counts with a short context, then with none
        one = np.uint64(8)
        short = grams & np.uint64((1 << 8 * (SHORT + 1)) - 1)
        kinds, n = _sums(short, np.ones(len(short)))
        contexts, total = _sums(kinds >> one, n)
        bytes_, m = _sums(kinds & np.uint64(255), np.ones(len(kinds)))
        none = _look(bytes_, m / max(m.sum(), 1), kinds & np.uint64(255), 1 / 256) * 0.99 + 0.01 / 256
        whole = _look(contexts, total, kinds >> one, 1.0)
        spread, types = _sums(kinds >> one, np.minimum(n, 0.75))
        below = np.maximum(n - 0.75, 0) / whole + _look(spread, types, kinds >> one, 0.0) / whole * none
        # the classes' own counts
        self.known, first = np.unique(grams, return_index=True)
        context = self.known >> one
        backoff = _look(kinds, below, short[first], 1e-6)
        at = np.searchsorted(self.known, grams)
        prob, self.contexts, spare = [], np.unique(context), []
        for c in each:
            own = np.bincount(at, c[owner], minlength=len(self.known)) if len(grams) else np.zeros(0)
            kept = np.maximum(own - DISCOUNT, 0)
            _, sums = _sums(context, own)
            _, left = _sums(context, kept)
            free = np.where(sums > 0, 1 - left / np.maximum(sums, 1e-9), 1.0)
            free = np.maximum(free, 1e-3)
            where = np.searchsorted(self.contexts, context)
            prob.append(kept / np.maximum(sums[where], 1e-9) + free[where] * backoff)
            spare.append(free)
        ratio = np.log(prob[1]) - np.log(prob[0]) if len(self.known) else np.zeros(0)
        self.spare = np.log(spare[1]) - np.log(spare[0]) if len(self.known) else np.zeros(0)
        told = np.abs(ratio - self.spare[np.searchsorted(self.contexts, context)]) > 1e-9 if len(self.known) else np.zeros(0, bool)
        self.known, self.ratio = self.known[told], ratio[told]  # the others follow from their context
        self.cache: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def learn(self, words: set[bytes]) -> None:
        """Put the words' log ratios into the cache."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            grams, owner, _ = _grams(some)
            other = _look(self.contexts, self.spare, grams >> np.uint64(8), 0.0)
            ratios = _look(self.known, self.ratio, grams, np.nan)
            sums = np.bincount(owner, np.where(np.isnan(ratios), other, ratios), minlength=len(some))
            self.cache.update(zip(some, sums.tolist(), strict=True))

    def evidence(self, words: list[bytes]) -> tuple[float, ...]:
        """Log ratio per word of the whole text and of its most toxic windows."""
        if not words:
            return (0.0,) * (1 + len(WINDOWS))
        own = set(words)
        self.learn(own)
        ratios = np.fromiter(map(self.cache.__getitem__, words), dtype=float, count=len(words))
        sums = np.concatenate([[0.0], np.cumsum(ratios)])
        out = [float(sums[-1] / len(ratios))]
        for window in WINDOWS:
            width = min(window, len(ratios))
            out.append(float((sums[width:] - sums[:-width]).max() / width))
        return tuple(out)


class Classifier:
    """The models and the logistic function over their evidence."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        texts = [(y, words_of(t)) for y, t in rows]
        self.models = Models(texts)
        mean = sum(y for y, _ in texts) / len(texts) if texts else 0.0
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        self.weights = np.array([math.log(mean / (1 - mean)), *[0.0] * (1 + len(WINDOWS))])
        if len({y for y, _ in texts}) == 2 and len(texts) >= 8:
            halves = texts[::2], texts[1::2]
            x, ys = [], []
            for a, b in (halves, halves[::-1]):
                if len({y for y, _ in a}) == 2:
                    models = Models(a)
                    x += [(1.0, *models.evidence(w)) for _, w in b]
                    ys += [y for y, _ in b]
            if len(set(ys)) == 2:
                self.weights = _logistic(np.array(x), np.array(ys, dtype=float))

    def score(self, text: bytes) -> float:
        z = float(self.weights @ np.array([1.0, *self.models.evidence(words_of(text))]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge; the classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)]) * len(y) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learns from labelled rows outside the held-out fold."""
    learnable = crc32_of_id(F.col("doc_id")) % FOLDS != HELD_OUT
    rows = sample(docs, labels, "toxic", learnable, PER_CLASS, MAX_CHARS)
    return Classifier([(y, t) for _, y, t in rows])


def scores(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Defined cases: null and empty texts, and texts without words, have no evidence
    and the score of that; without labelled rows of both classes the share of label 1
    is every score; a null doc_id is not held out; repeated rows are scored one by
    one; an empty table gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    model = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.score(t) for t in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scores(docs, fit(docs, load(spark, sf_dir, "labels")))


ORACLE_SQL = None
