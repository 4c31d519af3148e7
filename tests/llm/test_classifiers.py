import zlib

import numpy as np
import pytest

from docengine.llm import quality as Q
from docengine.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def held_out(spark, module, label):
    truth = {r.doc_id: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).collect()}
    rows = [r for r in module.query(spark, SF).collect()]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % module.FOLDS == module.HELD_OUT) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    return [(truth[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in truth]


@pytest.mark.parametrize(("module", "label"), [(Q, "quality"), (X, "toxic")])
def test_held_out_accuracy(spark, module, label):
    rows = held_out(spark, module, label)
    right = {y: np.mean([p == y for t, p, _ in rows if t == y]) for y in (0, 1)}
    pos, neg = ([s for t, _, s in rows if t == y] for y in (1, 0))
    auc = np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos])
    print(label, len(rows), right, auc)
    assert min(right.values()) > 0.9 and auc > 0.94


@pytest.mark.parametrize(("module", "label"), [(Q, "quality"), (X, "toxic")])
def test_odd_rows(spark, module, label):
    texts = [None, "", "  \n", "x " * 50_000, "plain text here", "plain text here"]
    docs = spark.createDataFrame([(i // 2 if i else None, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = module.scores(docs, module.fit(docs, some)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert module.scores(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0


def test_factor_identity():
    m = Q.Machine()
    places, x = Q.inputs(b"Some words, and 12 more words!\nAnd a line.")
    pairs = sum(m.factors[places[i]] @ m.factors[places[j]] * x[i] * x[j] for j in range(len(x)) for i in range(j))
    assert np.isclose(m.raw(places, x), m.bias + m.weights[places] @ x + pairs)


def test_ratios_follow_the_classes():
    texts = [(1, b"quiet bluntword day".split()), (0, b"quiet calm day".split())] * 6
    m = X.Models(texts)
    assert m.evidence([b"bluntword"])[0] > 1 > 0.5 > abs(m.evidence([b"quiet"])[0])
    assert m.evidence([b"bluntwords"])[1] > 1 and m.evidence([]) == (0.0, 0.0, 0.0)
    assert m.evidence([b"\xc3\xa9" * 9, b"quiet"])[0] < 1


def test_scores_are_those_of_all_pairs(spark):
    """The query against every pair of inputs added up one by one (as the upper half of a table of all products)."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = Q.fit(docs, labels)
    got = {r.doc_id: r.score for r in Q.query(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        places, x = Q.inputs(r.text.encode())
        v = machine.factors[places].astype(float) * x[:, None]
        pairs = np.triu(v @ v.T, 1).sum()
        z = machine.bias + machine.weights[places].astype(float) @ x + pairs
        assert np.isclose(got[r.doc_id], 1 / (1 + np.exp(-z)), atol=1e-4)


def plain_ratio(texts, word):
    """The log ratio of a word by dictionaries: each byte, given up to seven bytes before it."""
    counts = ({}, {})
    for y, words in texts:
        for w in set(words):
            counts[y][w] = counts[y].get(w, 0) + 1
    every = sorted({*counts[0], *counts[1]})
    steps = lambda w: [((b"^" + w + b"$")[max(0, k - 7) : k], (b"^" + w + b"$")[k]) for k in range(1, len(w) + 2)]
    low, mid = {}, {}
    for w in every:
        for c, b in steps(w):
            mid[c[-X.SHORT :], b] = mid.get((c[-X.SHORT :], b), 0) + 1
    for c, b in mid:
        low[b] = low.get(b, 0) + 1

    def backoff(c, b):
        c = c[-X.SHORT :]
        own = {k: n for (d, k), n in mid.items() if d == c}
        total = sum(own.values())
        none = 0.99 * low.get(b, 0) / sum(low.values()) + 0.01 / 256
        return max(own.get(b, 0) - 0.75, 0) / total + sum(min(n, 0.75) for n in own.values()) / total * none

    out = 0.0
    for c, b in steps(word):
        logs = []
        for y in (0, 1):
            seen = {}
            for w, n in counts[y].items():
                for d, k in steps(w):
                    if d == c:
                        seen[k] = seen.get(k, 0) + n
            known = any(d == c for w in every for d, _ in steps(w))
            if not known:
                logs.append(0.0)
                continue
            total = sum(seen.values())
            kept = {k: max(n - X.DISCOUNT, 0) for k, n in seen.items()}
            free = max(1 - sum(kept.values()) / total, 1e-3) if total else 1.0
            if any((d, k) == (c, b) for w in every for d, k in steps(w)):
                logs.append(np.log(kept.get(b, 0) / max(total, 1e-9) + free * backoff(c, b)))
            else:
                logs.append(np.log(free))
        out += logs[1] - logs[0]
    return out


def test_ratios_equal_the_plain_models():
    rng = np.random.default_rng(4)
    words = [b"quiet", b"quick", b"calm", b"blunt", b"bluntly", b"day", b"days", b"o"]
    texts = [(int(y), [words[k] for k in rng.integers(0, 5 if y else 8, 6)]) for y in rng.integers(0, 2, 40)]
    models = X.Models(texts)
    for w in [*words, b"quietly", b"new", b"blu"]:
        assert np.isclose(models.evidence([w])[0], plain_ratio(texts, w), atol=1e-9), w
