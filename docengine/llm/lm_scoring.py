"""Language-model scores by online logistic context mixing.

Texts are lower-cased (A-Z) and split into words and one end. The most frequent
``VOCAB`` words, the end and an escape are the leaves of a Huffman tree, so a token
is a path of binary decisions. The decisions on the upper ``DEPTH`` levels are
predicted by several bit predictors and mixed; below, the tree's own shares hold.

* Predictors: the share of the node in all text; hashed tables of counts for the
  node after the last one and two tokens; and the node's share in the document so far.
* Mixing: the predictions, as logits, are added up with weights. A gate, how much
  the tables have seen of the two contexts, chooses the set of weights.
* Refinement: after 8, 16, 32, 64 and 128 tokens, then after each segment of ``SEGMENT``
  tokens of a document, its weights and its own shares are adapted to what was seen. Each document
  starts anew from the fitted weights, so a score depends on the document and the model alone.
* Repeats: of all runs of ``RUN`` words (so long that frequent words seldom make one by chance) in the training texts one in ``SPACING``, chosen by its
  hash, is an anchor, whose continuation the model keeps. Where a text has an anchor that a training
  text has elsewhere (itself left out), the next token first costs one decision, whether it is
  the one that followed there. That is a mix, too, of the run's success so far, the last
  outcomes and the document's rate, adapted at each token. A token so told costs no more;
  another goes down the tree. These decisions follow one another in a document, so those of many
  documents are made side by side.

What the model gathers grows with the training texts: the table of all words and
that of all anchors are written tables, joined to the texts. Only the hashed tables are of a fixed size
(2^20 slots an order, without check tags), and the vocabulary of the tree (2^17 words).

Words that the training texts have once, or that are not among the most frequent,
are escapes, there too, so the predictors learn where new words come. An escaped
word that the training texts have costs its share of all rare words, exactly, by a
join with the table of all words. All words that they lack are one event in
``score``, as they are in the base score (V + 1 kinds); its share of the escapes is
that of the words seen once (Good-Turing). So both scores are about the same
events and the probabilities of what may come next add up to at most one. For
``bits_per_byte`` such a word is spelt in bytes as well, by a first-order model of
rare words.

Words are told apart by 64-bit hashes within a task, and by themselves in the table of all
words. Tasks fill hashed tables that are added up in a tree, sixty-four at a time. The starting
weights are fitted on a slice of the training texts, all of it, over tables of the
others; then the slice's own counts are added to the tables.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import crc32_of_id, discard, key_filter, load, may_hold, ship_code, text_bytes, written

NAME = "op5_lm_scoring"
FOLDS, HELD_OUT = 5, 1
VOCAB = 1 << 17
DEPTH = 10
ORDERS = 2
TABLE_BITS = 20
CHUNK = 1 << 13
FAN_IN = 64
SEGMENT = 128
SLICE = 50
ROUNDS = 4
RATE = 0.02
RUN = 8
SPACING = 32
LONGEST = 128
DOCS_AT_ONCE = 300
MIXED_AT_ONCE = 120  # so that arrays of decisions stay in cache
BYTES_AT_ONCE = 1 << 20
REPEATED_AT_ONCE = 4  # that many times more of the texts with repeats, which are told together
SYMBOLS_AT_ONCE = 30_000
_TOGETHER = 10  # a turn of all documents takes as long as this many decisions one by one
_EARLY = np.array([8, 16, 32, 64, 128])
_INPUTS = ORDERS + 3
_UPPER_BITS = 17
_GATES = 16
_LN10 = math.log(10)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_BYTE = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(BYTES_AT_ONCE, x, np.uint64)])) for x in (_STEP, _BACK)]


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Tokens:
    """The words of some texts: lower-cased bytes, the words' places in them, their documents and hashes."""

    def __init__(self, texts: list[bytes]):
        self.n_docs = len(texts)
        self.low = _LOWER[np.frombuffer(b" " + b"".join(t + b" " for t in texts), np.uint8)]
        dark = self.low != 32
        edges = np.flatnonzero(dark[1:] != dark[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        after = 1 + np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        self.doc = np.searchsorted(after, self.starts, side="right")
        self.hashes = np.zeros(len(self.starts), np.uint64)
        at, n = 0, len(self.starts)
        while at < n:  # as many words as the table of powers reaches
            to = int(np.searchsorted(self.ends, self.starts[at] + BYTES_AT_ONCE, side="right"))
            if to == at:
                self.hashes[at] = xxhash.xxh3_64_intdigest(self.low[self.starts[at] : self.ends[at]].tobytes())
                at += 1
                continue
            begin, end = int(self.starts[at]), int(self.ends[to - 1])
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(_BYTE[self.low[begin:end]] * _POWERS[0][: end - begin], out=sums[1:])
            first = self.starts[at:to] - begin
            own = (sums[self.ends[at:to] - begin] - sums[first]) * _POWERS[1][first]
            own ^= own >> np.uint64(32)
            own *= np.uint64(0xD6E8FEB86659FD93)
            self.hashes[at:to] = own ^ own >> np.uint64(29)
            at = to

    def words(self, which: np.ndarray) -> pa.Array:
        """The words themselves, as one array of bytes."""
        n = self.ends[which] - self.starts[which]
        ends = np.cumsum(n)
        data = self.low[np.repeat(self.starts[which] - ends + n, n) + np.arange(int(n.sum()))]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _groups(batches: Iterator[pa.RecordBatch], docs: int = DOCS_AT_ONCE, n_bytes: int = BYTES_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Some rows at a time with their words: at most ``docs``, and about ``n_bytes`` of text."""
    for batch in batches:
        at, held, size = 0, [], 0
        for k, text in enumerate(text_bytes(batch, "text"), 1):
            held.append(text)
            size += len(text)
            if len(held) == docs or size >= n_bytes or k == batch.num_rows:
                yield batch.slice(at, k - at), Tokens(held)
                at, held, size = k, [], 0


def anchors(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(the last word, the name) of each run of ``RUN`` words that is an anchor."""
    own = tokens.hashes
    if len(own) < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    name = own[: len(own) - RUN + 1].copy()
    for k in range(1, RUN):
        name = name * np.uint64(_STEP) + own[k : len(own) - RUN + 1 + k]
    name ^= name >> np.uint64(31)
    name *= np.uint64(0xD6E8FEB86659FD93)
    inside = tokens.doc[RUN - 1 :] == tokens.doc[: len(own) - RUN + 1]
    at = np.flatnonzero(inside & (name >> np.uint64(48) & np.uint64(SPACING - 1) == 0))
    return at + RUN - 1, name[at].view(np.int64)


class Code:
    """The Huffman tree: upper paths, and the logarithm of what is left of each leaf."""

    def __init__(self, words: list[tuple[bytes, int]], n_docs: int, escapes: int):
        own = Tokens([w for w, _ in words]).hashes
        order = np.argsort(own)
        self.names, self.rank = own[order], order
        # where the words begin whose hashes have the same upper bits
        self.first = np.searchsorted(self.names, np.arange(1 << _UPPER_BITS, dtype=np.uint64) << np.uint64(64 - _UPPER_BITS))
        self.first = np.append(self.first, len(own)).astype(np.int32)
        self.end, self.escape = len(words), len(words) + 1
        counts = np.array([c for _, c in words] + [max(n_docs, 1), escapes + 1], dtype=float)
        self.counts = np.array([c for _, c in words] + [n_docs, 0], dtype=float)
        n = len(counts)
        heap = [(c, k) for k, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        total = np.concatenate([counts, np.zeros(n)])
        left, right = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        top = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            left[top], right[top], total[top] = i, j, a + b
            heapq.heappush(heap, (a + b, top))
            top += 1
        self.steps = np.zeros((n, DEPTH), np.uint16)  # twice the node and the bit
        self.length = np.zeros(n, np.int64)
        self.rest = np.zeros(n)
        self.static = np.zeros(1 << DEPTH)
        stack = [(heap[0][1], 0, 1, [])]
        while stack:
            at, depth, name, path = stack.pop()
            if depth == DEPTH or at < n:
                leaves, inner = [], [at]
                while inner:
                    x = inner.pop()
                    if x < n:
                        leaves.append(x)
                    else:
                        inner += [left[x], right[x]]
                leaves = np.array(leaves)
                for d, (node, bit) in enumerate(path):
                    self.steps[leaves, d] = 2 * node + bit
                self.length[leaves] = depth
                self.rest[leaves] = np.log(counts[leaves] / total[at])
                continue
            self.static[name] = math.log(total[right[at]] / total[left[at]])
            stack.append((left[at], depth + 1, 2 * name, [*path, (name, 0)]))
            stack.append((right[at], depth + 1, 2 * name + 1, [*path, (name, 1)]))
        rng = np.random.default_rng(3)
        self.hash = rng.integers(0, 1 << 32, n + 1, dtype=np.uint64).astype(np.uint32)

    @property
    def nodes(self) -> np.ndarray:
        return self.steps >> 1

    @property
    def bits(self) -> np.ndarray:
        return self.steps & 1

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word; from ``escape + 1`` on an integer that stands for the escaped word itself."""
        out = (self.escape + 1 + (hashes >> np.uint64(33))).astype(np.int64)
        upper = (hashes >> np.uint64(64 - _UPPER_BITS)).astype(np.int64)
        at, end = self.first[upper], self.first[upper + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.names[at] == hashes[left]
            out[left[same]] = self.rank[at[same]]
            at += 1
            more = ~same & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out

    def documents(self, tokens: Tokens, codes: np.ndarray | None = None) -> list[np.ndarray]:
        """The codes of each document, with its end."""
        ends = np.searchsorted(tokens.doc, np.arange(tokens.n_docs), side="right")
        codes = self.codes(tokens.hashes) if codes is None else codes
        return np.split(np.insert(codes, ends, self.end), (ends + np.arange(1, tokens.n_docs + 1))[:-1])

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return np.minimum(self.documents(Tokens([b" ".join(words)]))[0], self.escape)


def _contexts(code: Code, symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last one and two symbols; ``first`` is the place of each symbol in its document."""
    own = code.hash[symbols]
    out, mixed = [], np.zeros(len(symbols), np.uint32)
    for k in range(1, ORDERS + 1):
        before = np.full(len(symbols), code.hash[-1])
        before[k:] = np.where(first[k:] >= k, own[:-k], code.hash[-1])
        mixed = (mixed * np.uint32(0x9E3779B1)) ^ before
        mixed ^= mixed >> np.uint32(15)
        out.append(mixed * np.uint32(0x85EBCA6B) + np.uint32(k))
    return out


def _hashed(node: np.ndarray) -> np.ndarray:
    return node.astype(np.uint32) * np.uint32(0xC2B2AE35)


def _slots(context: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The slot of each decision; ``context`` has an entry for each, ``hashed`` is that of its node."""
    x = context + hashed
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x >>= np.uint32(32 - TABLE_BITS)
    return x.astype(np.intp)


def _steps(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All mixed decisions: (each symbol's first one, its symbol's index, twice the node and the bit)."""
    length = code.length.take(symbols)
    firsts = np.cumsum(length) - length
    which = np.repeat(np.arange(len(symbols)), length)
    place = np.repeat(symbols * DEPTH - firsts, length)
    place += np.arange(len(which))
    return firsts, which, code.steps.reshape(-1).take(place).astype(np.intp)


def count_tables(code: Code, docs: Iterator[np.ndarray]) -> np.ndarray:
    """(orders, slots, 2): how often a slot was seen, and with bit 1; from the symbols of documents."""
    out = np.zeros((ORDERS, 1 << TABLE_BITS, 2), np.uint32)
    held, n = [], 0

    def flush() -> None:
        symbols = np.concatenate(held)
        sizes = np.array([len(h) for h in held])
        first = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _, which, step = _steps(code, symbols)
        hashed, bit = _hashed(step >> 1), step & 1
        for k, context in enumerate(_contexts(code, symbols, first)):
            np.add.at(out[k].reshape(-1), _slots(context.take(which), hashed) * 2 + bit, np.uint32(1))

    for symbols in docs:
        held.append(symbols)
        n += len(symbols)
        if n > SYMBOLS_AT_ONCE:
            flush()
            held, n = [], 0
    if held:
        flush()
    out[:, :, 0] += out[:, :, 1]  # from then on the first number is of all
    return out


class Mixer:
    """The predictors' tables and the weights that a document starts with."""

    def __init__(self, code: Code, counts: np.ndarray):
        self.code = code
        self.tables = np.empty(counts.shape[:2], np.int16)
        for k, table in enumerate(counts):
            n, ones = table[:, 0].astype(np.float32), table[:, 1].astype(np.float32)
            logit = np.log((ones + np.float32(0.2)) / (n - ones + np.float32(0.2)))
            seen = (n > 0).astype(np.int16) + (n > 2) + (n > 15)
            self.tables[k] = (np.clip(np.round(logit * 256), -8000, 8000).astype(np.int16) * 4) | seen
        start = [0.6, 0.25, 0.25, 0.3, 0.0]
        self.weights = np.tile(np.array(start, dtype=np.float64), (_GATES, 1))

    def score(self, docs: list[np.ndarray], keep: np.ndarray | None = None, paid: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural log probability of each document's symbols, or of those that are ``paid``; ``keep`` gets the adapted weights."""
        code = self.code
        order = np.argsort([-len(d) for d in docs], kind="stable")
        sizes = np.array([len(docs[k]) for k in order])
        symbols = np.concatenate([docs[k] for k in order])
        first = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(np.arange(len(docs)), sizes)
        contexts = _contexts(code, symbols, first)
        counted = np.ones(len(symbols), bool) if paid is None else np.concatenate([paid[k] for k in order])
        total = np.bincount(owner, code.rest[symbols] * counted, minlength=len(docs))
        weights = np.tile(self.weights.T, (1, len(docs)))  # a row for each input, a place for each document and gate
        seen = np.zeros(len(docs) << DEPTH + 1, np.uint32)  # how often each document took each bit at each node
        static = code.static
        four = 4 / (1 + np.exp(-static))
        four = four.astype(np.float32), (4 - four).astype(np.float32)
        segment = np.where(first < SEGMENT, np.searchsorted(_EARLY, first, side="right"), len(_EARLY) - 1 + first // SEGMENT)
        by_segment = np.argsort(segment, kind="stable")
        ends = np.cumsum(np.bincount(segment))
        at = 0
        for end in ends:
            rows = by_segment[at:end]
            at = end
            rows = rows[counted[rows]]
            if not len(rows):
                continue
            active = int(owner[rows[-1]]) + 1  # documents are in order of length
            firsts, which, step = _steps(code, symbols[rows])
            node, bit = step >> 1, step & 1
            hashed = _hashed(node)
            doc = owner[rows].take(which)
            inputs, gate = [static.take(node)], 0
            for k in range(ORDERS):
                found = self.tables[k].take(_slots(contexts[k][rows].take(which), hashed))
                if k in (0, 1):
                    gate = gate * 4 + (found & 3)
                inputs.append(np.multiply(found >> 2, 1 / 256, dtype=np.float64))
            place = (doc << DEPTH) + node
            both = seen.view(np.uint64).take(place).view(np.uint32).astype(np.float32)  # the two numbers at once
            n0, n1 = both[::2], both[1::2]
            own = np.log((n1 + four[0].take(node)) / (n0 + four[1].take(node)))  # in single precision, as an input
            own *= n1 + n0 > 0
            inputs.append(own.astype(np.float64))
            group = doc * _GATES + gate
            z = weights[-1].take(group)
            for k, x in enumerate(inputs):
                w = weights[k].take(group)
                w *= x
                z += w
            sign = bit * 2.0 - 1
            wide = np.abs(z)
            z *= sign
            rest = np.exp(-wide)
            sums = rest + 1
            # a symbol's factors are at most 2 each, so their product has one logarithm
            cost = np.log(np.multiply.reduceat(sums, firsts)) + np.add.reduceat(wide - z, firsts) / 2
            total[:active] -= np.bincount(doc[firsts], cost, minlength=active)
            error = rest + (1 - rest) * (z < 0)
            error /= sums
            error *= sign
            count = np.bincount(group, minlength=active * _GATES)
            scale = RATE / np.sqrt(np.maximum(count, 1))
            for k, x in enumerate(inputs):
                x *= error
                weights[k, : active * _GATES] += scale * np.bincount(group, x, minlength=active * _GATES)
            weights[-1, : active * _GATES] += scale * np.bincount(group, error, minlength=active * _GATES)
            place *= 2
            place += bit
            np.add.at(seen, place, np.uint32(1))
        if keep is not None:
            keep += weights.reshape(_INPUTS, len(docs), _GATES).mean(axis=1).T
        out = np.empty(len(docs))
        out[order] = total
        return out

    def calibrate(self, docs: list[np.ndarray]) -> None:
        """Start from the weights that documents end with, some times over."""
        for _ in range(ROUNDS if docs else 0):
            ends = np.zeros_like(self.weights)
            self.score(docs, ends)
            self.weights = ends


def told(expected: np.ndarray, codes: np.ndarray) -> tuple[float, np.ndarray]:
    """(natural log probability of the decisions, whether each token was told) for expected codes, -1 where there is none."""
    hits = np.zeros(len(codes), bool)
    total, last, run, history = 0.0, -2, 0, 0
    weights = [0.5, 0.4, 0.3]
    by_run, by_history, rate = [[0.0, 0.0] for _ in range(16)], [[0.0, 0.0] for _ in range(16)], [1.0, 1.0]
    at = np.flatnonzero(expected >= 0)
    for k, want, code in zip(at.tolist(), expected[at].tolist(), codes[at].tolist(), strict=True):
        if k != last + 1:
            run = history = 0
        last = k
        one, two = by_run[min(run, 15)], by_history[history]
        x = (
            math.log((one[1] + 1.5 + run) / (one[0] + 1.0)),
            math.log((two[1] + 1.0) / (two[0] + 1.0)),
            math.log(rate[1] / rate[0]),
        )
        z = weights[0] * x[0] + weights[1] * x[1] + weights[2] * x[2]
        p = 1 / (1 + math.exp(-max(-12.0, min(12.0, z))))
        hit = want == code
        total += math.log(p if hit else 1 - p)
        slope = RATE * ((1.0 if hit else 0.0) - p)
        weights = [w + slope * v for w, v in zip(weights, x, strict=True)]
        one[hit] += 1
        two[hit] += 1
        rate[hit] += 1
        run = run + 1 if hit else 0
        history = (history * 2 + hit) & 15
        hits[k] = hit
    return total, hits


def told_together(expected: list[np.ndarray], codes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """``told`` of several documents, a decision of each at a time; the few that have by far the most are taken alone."""
    totals, hits = np.zeros(len(codes)), [np.zeros(len(c), bool) for c in codes]
    places = [np.flatnonzero(e >= 0) for e in expected]
    sizes = np.array([len(p) for p in places], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = np.append(sizes[order], 0)
    alone = int(np.argmin(np.cumsum(sizes) - sizes + _TOGETHER * sizes))
    for k in order[:alone]:
        totals[k], hits[k] = told(expected[k], codes[k])
    order, sizes = order[alone:], sizes[alone:-1]
    if not len(order) or not sizes[0]:
        return totals, hits
    # all decisions, the first ones of the documents before the second ones
    at = np.concatenate([places[k] for k in order])
    ends = np.cumsum(sizes)
    turn = np.arange(len(at)) - np.repeat(ends - sizes, sizes)
    going = np.diff(at, prepend=-2) == 1
    going[(ends - sizes)[sizes > 0]] = False
    same = np.concatenate([expected[k][places[k]] == codes[k][places[k]] for k in order])
    by_turn = np.argsort(turn, kind="stable")
    going, same = going[by_turn].astype(np.int64), same[by_turn].astype(np.int64)
    n, chance, at = len(order), np.empty(len(at)), 0
    run, history = np.zeros((2, n), np.int64)
    # for each document pairs of how often missed and hit, each begun as in ``told``: by run, by history, and of all
    counts = np.tile([1.0, 1.5] * 16 + [1.0, 1.0] * 17, n)
    base = np.arange(n) * 66 + np.array([[0], [32], [64]])
    weights = np.repeat([[0.5], [0.4], [0.3]], n, axis=1)
    for active in np.bincount(turn).tolist():
        hit = same[at : at + active]
        if active < len(run):
            run, history, base, weights = run[:active], history[:active], base[:, :active], weights[:, :active]
        run *= going[at : at + active]
        history *= going[at : at + active]
        where = base.copy()
        where[0] += np.minimum(run, 15) * 2
        where[1] += history * 2
        x = counts.take(where + 1)
        x[0] += run
        x /= counts.take(where)
        np.log(x, out=x)
        z = np.add.reduce(weights * x, axis=0)
        np.minimum(z, 12.0, out=z)
        np.maximum(z, -12.0, out=z)
        p = 1 / (1 + np.exp(-z))
        chance[at : at + active] = p
        x *= RATE * (hit - p)
        weights += x
        where += hit
        counts[where] += 1
        run += 1
        run *= hit
        history *= 2
        history += hit
        history &= 15
        at += active
    cost = np.empty(len(chance))
    cost[by_turn] = np.log(np.where(same, chance, 1 - chance))
    told_so = np.empty(len(same), bool)
    told_so[by_turn] = same
    for k, end, size in zip(order.tolist(), ends.tolist(), sizes.tolist(), strict=True):
        totals[k] = cost[end - size : end].sum()
        hits[k][places[k]] = told_so[end - size : end]
    return totals, hits


def _expected(n: int, found: list[dict] | None) -> np.ndarray:
    """What is expected at each of ``n`` places, by the last anchor before it."""
    out = np.full(n, -1, np.int64)
    for x in sorted(found or (), key=lambda x: x["pos"]):
        codes = np.frombuffer(x["codes"], "<u4")[: n - x["pos"] - 1]
        out[x["pos"] + 1 : x["pos"] + 1 + len(codes)] = codes
    return out


def spelling(pairs: dict[int, int]) -> np.ndarray:
    """Natural log probabilities (byte before, byte); 32 stands before the first and for the end."""
    counts = np.full((256, 256), 0.05)
    for key, n in pairs.items():
        counts[key >> 8, key & 255] += n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, tokens in _groups(batches, 1 << 14):
        _, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([tokens.words(first), pa.array(n, type=pa.int64())], ["word", "c"])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        data = np.frombuffer(b" ".join([b"", *batch.column("word").to_pylist(), b""]), dtype=np.uint8).astype(np.int64)
        counts += np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16)
    counts[32 * 257] = 0
    keys = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[keys])], ["pair", "n"])


def _packed(task: int, tables: np.ndarray) -> Iterator[dict]:
    flat = tables.reshape(-1, 2)
    for k in range(0, len(flat), CHUNK):
        part = flat[k : k + CHUNK]
        if part[:, 0].any():
            yield {"task": task, "chunk": k // CHUNK, "data": part.T.astype("<u4").tobytes()}


_PART = pa.schema([("task", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(2 * CHUNK, np.int64)
    for data in table.column("data"):
        total += np.frombuffer(data.as_py(), "<u4")
    top = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
    row = {"task": key[1].as_py(), "chunk": key[0].as_py(), "data": top}
    return pa.Table.from_pylist([row], schema=_PART)


_ENDS = pa.schema([("task", pa.int32()), ("n", pa.int64()), ("ends", pa.list_(pa.float64()))])


class Model:
    """What scoring needs: the mixer, the spelling, totals of the training texts, and these themselves for their repeats."""

    def __init__(self, mixer: Mixer, spelled: np.ndarray, total: int, distinct: int, rare: int, once: int, words: DataFrame, source: DataFrame):
        self.mixer, self.spelled, self.words, self.source = mixer, spelled, words, source
        self.total, self.distinct, self.rare, self.once = total, distinct, rare, once


def _symbols(code: Code, tokens: Tokens) -> list[np.ndarray]:
    return [np.minimum(x, code.escape) for x in code.documents(tokens)]


def fit_weights(mixer: Mixer, held: DataFrame) -> None:
    """What ``calibrate`` does, over all texts of a table: tasks add up the weights that documents end with."""

    def run(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ends, n = None, 0
        for _, tokens in _groups(batches):
            own = shared.value
            mean = np.zeros_like(own.weights)
            own.score(_symbols(own.code, tokens), mean)
            ends = mean * tokens.n_docs + (0 if ends is None else ends)
            n += tokens.n_docs
        if n:
            row = {"task": TaskContext.get().partitionId(), "n": n, "ends": ends.ravel().tolist()}
            yield pa.RecordBatch.from_pylist([row], schema=_ENDS)

    for _ in range(ROUNDS):
        shared = held.sparkSession.sparkContext.broadcast(mixer)
        rows = held.mapInArrow(partial(run, shared=shared), "task int, n long, ends array<double>").collect()  # one short row a task
        shared.destroy()
        if not rows:
            return
        rows.sort(key=lambda r: r.task)
        mixer.weights = np.sum([r.ends for r in rows], axis=0).reshape(mixer.weights.shape) / sum(r.n for r in rows)


def _learnable() -> Column:
    return F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS != HELD_OUT, F.lit(True))


def train(docs: DataFrame) -> Model:
    """Learns from the rows outside the held-out fold; a null doc_id is in no fold and is learnt from."""
    spark = docs.sparkSession
    ship_code(spark)
    texts = docs.filter(_learnable()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = texts.select("text").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    words = written(words, "lm-words")
    n_words, distinct, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    n_docs = texts.count()
    most = words.filter("c > 1").orderBy(F.desc("c"), "word").limit(VOCAB).toArrow()
    top = list(zip(most.column("word").to_pylist(), most.column("c").to_pylist(), strict=True))
    del most
    rare = n_words - sum(c for _, c in top)
    code = Code(top, n_docs, rare + once)
    least = top[-1][1] if len(top) == VOCAB else 0
    pairs = words.filter(F.col("c") <= max(least, 2)).select("word").mapInArrow(_count_pairs, "pair long, n long")
    spelled = spelling({r[0]: r[1] for r in pairs.groupBy("pair").agg(F.sum("n")).collect()})
    shared = spark.sparkContext.broadcast(code)
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(SLICE)) == 0

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = count_tables(shared.value, (x for _, t in _groups(batches) for x in _symbols(shared.value, t)))
        for row in _packed(TaskContext.get().partitionId(), tables):
            yield pa.RecordBatch.from_pylist([row], schema=_PART)

    def gathered(some: DataFrame) -> np.ndarray:
        schema = "task long, chunk int, data binary"
        n = some.rdd.getNumPartitions()
        parts = written(some.mapInArrow(fill, schema), "lm-tables")
        while True:
            n = -(-n // FAN_IN)
            added = parts.withColumn("into", F.expr(f"task div {FAN_IN}")).groupBy("chunk", "into").applyInArrow(_added, schema)
            added = written(added, "lm-tables")
            discard(parts)
            parts = added
            if n <= 1:
                break
        counts = np.zeros((ORDERS << TABLE_BITS, 2), np.uint32)
        for r in parts.toLocalIterator():  # tables of a fixed size
            data = np.frombuffer(bytes(r.data), "<u4").reshape(2, CHUNK)
            counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = data.T
        discard(parts)
        return counts.reshape(ORDERS, -1, 2)

    held = written(texts.filter(aside).select("text"), "lm-slice")
    counts = gathered(texts.filter(~aside).select("text"))
    mixer = Mixer(code, counts)
    fit_weights(mixer, held)
    weights = mixer.weights
    more = gathered(held)
    discard(held)
    counts += np.minimum(more, np.uint32(2**32 - 1) - counts)
    del more, mixer
    mixer = Mixer(code, counts)
    mixer.weights = weights
    del counts
    return Model(mixer, spelled, n_words + n_docs, distinct + (n_docs > 0), rare, once, words, docs)


def _anchor_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, tokens in _groups(batches):
        at, name = anchors(tokens)
        learn = rows.column("learn").take(pa.array(tokens.doc[at]))
        yield pa.RecordBatch.from_arrays([pa.array(name), learn], ["name", "learn"])


def _continued(batches: Iterator[pa.RecordBatch], shared, wanted) -> Iterator[pa.RecordBatch]:
    """(name, uid, pos, learn, codes): anchors that may be somewhere else too, and what follows up to the next one."""
    for rows, tokens in _groups(batches):
        at, name = anchors(tokens)
        docs = shared.value.documents(tokens)
        doc = tokens.doc[at]
        begin = np.searchsorted(tokens.doc, np.arange(tokens.n_docs))
        pos = at - begin[doc]
        upto = np.full(len(at), LONGEST, np.int64)
        upto[:-1] = np.where(doc[1:] == doc[:-1], np.minimum(at[1:] - at[:-1], LONGEST), LONGEST)
        take = np.flatnonzero(may_hold(wanted.value, name))
        codes = [docs[d][p + 1 : p + 1 + n].astype("<u4").tobytes() for d, p, n in zip(doc[take].tolist(), pos[take].tolist(), upto[take].tolist(), strict=True)]
        own = pa.array(doc[take])
        columns = [pa.array(name[take]), rows.column("uid").take(own), pa.array(pos[take]), rows.column("learn").take(own), pa.array(codes, type=pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["name", "uid", "pos", "learn", "codes"])


def repeats(docs: DataFrame, model: Model) -> DataFrame:
    """(uid, found) of texts that have an anchor of a training text elsewhere: what followed it there, by place.

    ``docs`` has uid and text. Of the training texts that share an anchor the first speaks, for
    itself the last. Counts and first ones are aggregated before they are shuffled, and only names that
    occur twice are kept with what follows them.
    """
    spark = docs.sparkSession
    own = model.source.select(_uid(), _learnable().alias("learn"), "text")
    if not docs.sameSemantics(model.source.select("doc_id", "text", _uid())):
        own = own.filter("learn").unionByName(docs.select("uid", F.lit(False).alias("learn"), "text"))
    names = own.mapInArrow(_anchor_names, "name long, learn boolean").groupBy("name")
    names = names.agg(F.count("*").alias("n"), F.max("learn").alias("any")).filter("n > 1 and any").select("name")
    names = written(names, "lm-names")
    shared, wanted = spark.sparkContext.broadcast(model.mixer.code), key_filter(names)
    rows = own.mapInArrow(partial(_continued, shared=shared, wanted=wanted), "name long, uid long, pos long, learn boolean, codes binary")
    rows = written(rows.join(names, "name", "left_semi"), "lm-anchors")
    one = F.struct("uid", "pos", "codes")
    ends = rows.filter("learn").groupBy("name").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    ends = written(ends, "lm-ends")
    mine = lambda x: (F.col(f"{x}.uid") == F.col("uid")) & (F.col(f"{x}.pos") == F.col("pos"))
    codes = F.when(~mine("low"), F.col("low.codes")).when(~mine("high"), F.col("high.codes"))
    found = rows.join(ends, "name").select("uid", "pos", codes.alias("codes")).filter("codes is not null").distinct()
    return written(found.groupBy("uid").agg(F.collect_list(F.struct("pos", "codes")).alias("found")), "lm-found")


def _uid() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("uid")


_RARE = pa.struct([("word", pa.binary()), ("n", pa.int64()), ("paid", pa.int64()), ("spelt", pa.float64())])
_ROW_SQL = "row long, n_bytes long, n_tokens long, n_known long, base double, mixed double, rare array<struct<word:binary,n:long,paid:long,spelt:double>>"


def score_rows(mixer: Mixer, spelled: np.ndarray, tokens: Tokens, found: list[list[dict] | None]) -> list[pa.Array]:
    """What the documents' own task can tell: all but the counts of their rare words."""
    code, n_docs = mixer.code, tokens.n_docs
    codes = code.codes(tokens.hashes)
    docs = code.documents(tokens, codes)
    total, hits = told_together([_expected(len(own), x) for own, x in zip(docs, found, strict=True)], docs)
    paid = [~x for x in hits]
    symbols = [np.minimum(x, code.escape) for x in docs]
    by_length = np.argsort([-len(x) for x in symbols], kind="stable")
    for k in range(0, n_docs, MIXED_AT_ONCE):
        some = by_length[k : k + MIXED_AT_ONCE]
        total[some] += mixer.score([symbols[d] for d in some], paid=[paid[d] for d in some])
    known = codes < code.end
    lengths = np.bincount(tokens.doc, minlength=n_docs)
    base = np.bincount(tokens.doc[known], np.log10(code.counts[codes[known]] + 0.5), minlength=n_docs) + math.log10(code.counts[code.end] + 0.5)
    n_known = np.bincount(tokens.doc[known], minlength=n_docs) + int(code.counts[code.end] > 0)
    # the rare words of each document, once each
    rare = np.flatnonzero(~known)
    order = np.lexsort((tokens.hashes[rare], tokens.doc[rare]))
    rare = rare[order]
    doc, own = tokens.doc[rare], tokens.hashes[rare]
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])][: len(rare)])
    n = np.diff(np.append(starts, len(rare)))
    costs = np.concatenate([x[:-1] for x in paid])[rare].astype(np.int64) if n_docs else np.zeros(0, np.int64)
    first = rare[starts]
    pairs = (tokens.low[:-1].astype(np.uint16) << 8) | tokens.low[1:]
    sums = np.concatenate([[0.0], np.cumsum(spelled.reshape(-1).take(pairs))])  # up to each place
    spelt = sums[tokens.ends[first]] - sums[tokens.starts[first] - 1]
    added = np.add.reduceat(costs, starts) if len(starts) else np.zeros(0, np.int64)
    inner = pa.StructArray.from_arrays([tokens.words(first), pa.array(n, type=pa.int64()), pa.array(added, type=pa.int64()), pa.array(spelt)], fields=list(_RARE))
    offsets = np.searchsorted(doc[starts], np.arange(n_docs + 1)).astype(np.int32)
    return [pa.array(x) for x in (lengths + 1, n_known, base, total)] + [pa.ListArray.from_arrays(pa.array(offsets), inner)]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Defined cases: a null or empty text is its end alone; repeated rows are scored
    one by one, and those with one doc_id and text are no repeats of each other; bits_per_byte is null
    for an empty text; an empty table gives an empty result, and without training texts every
    word is spelt. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast((model.mixer, model.spelled))
    texts = docs.select("doc_id", "text", _uid())
    found = repeats(texts, model)
    held = key_filter(found.select("uid"))

    def run(batches: Iterator[pa.RecordBatch], joined: bool) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        if not joined:
            batches = (b.filter(pa.array(~may_hold(held.value, b.column("uid").to_numpy()))) for b in batches)
        more = REPEATED_AT_ONCE if joined else 1
        for rows, tokens in _groups(batches, more * DOCS_AT_ONCE, more * BYTES_AT_ONCE):
            mixer, spelled = shared.value
            known = rows.column("found").to_pylist() if joined else [None] * rows.num_rows
            size = [len(t) for t in text_bytes(rows, "text")]
            columns = [rows.column("doc_id"), pa.array(range(row, row + len(size)), type=pa.int64()), pa.array(size, type=pa.int64())]
            columns += score_rows(mixer, spelled, tokens, known)
            row += len(size)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_bytes", "n_tokens", "n_known", "base", "mixed", "rare"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(held.value, b.column("uid").to_numpy())))

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {_ROW_SQL}"
    marked = texts.mapInArrow(some, texts.schema).join(found, "uid", "left")
    rows = texts.mapInArrow(partial(run, joined=False), schema).unionByName(marked.mapInArrow(partial(run, joined=True), schema))
    rows = written(rows, "lm-rows")
    new = (model.once + 0.5) / (model.rare + model.once + 1)  # the share of new words among the escapes
    each = rows.select("row", F.inline("rare"))
    known, n, paid = F.col("c") > 0, F.col("n"), F.col("paid")
    rare = F.log(F.col("c") / F.lit(float(max(model.rare, 1)))) + math.log(1 - new)
    joined = each.join(model.words, "word", "left").select(
        "row",
        F.when(known, n).otherwise(0).alias("known"),
        (n * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("base"),
        (paid * F.when(known, rare).otherwise(F.lit(math.log(new)))).alias("mixed"),
        F.when(known, 0.0).otherwise(paid * F.col("spelt")).alias("spelt"),
    )
    sums = joined.groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("mixed").alias("m"), F.sum("spelt").alias("s"))
    sums = written(sums, "lm-rare")
    below = math.log10(model.total + 0.5 * (model.distinct + 1))
    zero = F.lit(0.0)
    score = (F.col("mixed") + F.coalesce("m", zero)) / _LN10
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        F.coalesce(crc32_of_id(F.col("doc_id")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) - F.col("n_tokens") * below).alias("base_score"),
        score.alias("score"),
        F.when(F.col("n_bytes") > 0, -(score * _LN10 + F.coalesce("s", zero)) / math.log(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return scores(docs, train(docs))


ORACLE_SQL = None
