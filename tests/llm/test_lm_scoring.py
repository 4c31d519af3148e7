import math
import time
import zlib
from collections import Counter

import numpy as np

from docengine.llm import lm_scoring as L


def fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def base(rows):
    counts = Counter()
    for d, t in rows:
        if not fold(d):
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        score = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((d, fold(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, score))
    return out


def same(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    for g, w in zip(sorted(got, key=key), sorted(base(rows), key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert math.isclose(g.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_base_and_better_than_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = L.query(spark, sf).collect()
    same(got, rows)
    out = [r for r in got if r.held_out]
    print("held out: base", sum(r.base_score for r in out), "model", sum(r.score for r in out), "bits/byte", np.mean([r.bits_per_byte for r in out]))
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, "One two one"), (2, "One two one"), (None, "x y"), (6, " \n\t "), (7, "w" * 3000), (9, "a b " * 20_000)]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, word string")
    got = L.scores(docs, L.train(docs)).collect()
    same(got, rows)
    assert all(r.score < 0 for r in got)
    assert L.scores(docs.limit(0), L.train(docs.limit(0))).count() == 0


def test_probabilities_of_next_tokens_add_up_to_one():
    words = [(w, c) for w, c in zip([b"a", b"b", b"c", b"d", b"e"], [50, 30, 12, 5, 1])]
    code = L.Code(words, 20, 4)
    texts = [b"a b a c".split(), b"b a d".split()] * 4
    mixer = L.Mixer(code, L.count_tables(code, map(code.symbols, texts)))
    mixer.calibrate([code.symbols(t) for t in texts])
    head = code.symbols([b"a"] * (L.SEGMENT + 3))[:-1]
    whole = mixer.score([head])[0]
    total = sum(math.exp(mixer.score([np.append(head, s)])[0] - whole) for s in range(len(words) + 2))
    assert math.isclose(total, 1, rel_tol=1e-9)


def test_score_depends_on_the_document_alone():
    words = [(b"w%d" % k, 100 - k) for k in range(60)]
    code = L.Code(words, 20, 4)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 60, n) for n in (3, 900, 40, 300)]
    mixer = L.Mixer(code, L.count_tables(code, iter(docs)))
    assert np.allclose(mixer.score(docs), [mixer.score([d])[0] for d in docs])


def test_slice_is_learnt_from_and_fits_the_weights_as_a_whole(spark):
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(40_000).filter(F.pmod(F.xxhash64("id"), F.lit(L.SLICE)) == 0).collect()]
    inside = [i for i in ids if not fold(i)]
    outside = [i for i in range(400) if i not in ids and not fold(i)]
    assert len(inside) > 400
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.5, 12) % 50)) for i in inside + outside]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string"))
    code, words = model.mixer.code, [L.tokens_of(t.encode()) for _, t in rows]
    assert (model.mixer.tables == L.Mixer(code, L.count_tables(code, map(code.symbols, words))).tables).all()
    local = L.Mixer(code, L.count_tables(code, map(code.symbols, words[len(inside) :])))
    local.calibrate([code.symbols(w) for w in words[: len(inside)]])
    assert np.allclose(model.mixer.weights, local.weights)


def test_words_are_those_of_the_plain_split():
    texts = [b"", b" One  two\tTHREE\x0b\n", b"x" * 50, "\u00c9t\u00e9 \u00a0nbsp\u2003".encode(), b"\x1c a"]
    tokens = L.Tokens(texts)
    plain = [(k, w) for k, t in enumerate(texts) for w in L.tokens_of(t)]
    assert list(zip(tokens.doc.tolist(), tokens.words(np.arange(len(plain))).to_pylist(), strict=True)) == plain
    assert len(set(tokens.hashes.tolist())) == len({w for _, w in plain})
    same = L.Tokens([b"zz One", b"one"]).hashes
    assert same[1] == same[2] != same[0]


def test_repeated_texts_are_told_and_others_are_not(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 4000, n))
    twice = text(400)
    rows = [(k, text(300)) for k in range(200)] + [(500, twice), (501, twice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.scores(docs, L.train(docs)).collect()}
    pair = max(got[500].bits_per_byte, got[501].bits_per_byte)
    assert pair < 0.5 * min(got[k].bits_per_byte for k in range(200))
    other = {r.doc_id: r.bits_per_byte for r in L.scores(docs.filter("doc_id < 20"), L.train(docs)).collect()}
    assert all(abs(other[k] - got[k].bits_per_byte) < 1e-9 for k in range(20))


def test_decisions_of_repeats_are_probabilities():
    rng = np.random.default_rng(3)
    expected = np.where(rng.random(60) < 0.7, rng.integers(0, 3, 60), -1)
    codes = rng.integers(0, 3, 60)
    head, _ = L.told(expected[:50], codes[:50])
    at = int(np.flatnonzero(expected >= 0)[30])
    before, _ = L.told(expected[:at], codes[:at])
    outcomes = []
    for code in (expected[at], expected[at] + 1):
        total, hits = L.told(expected[: at + 1], np.append(codes[:at], code))
        outcomes.append(math.exp(total - before))
        assert hits[at] == (code == expected[at])
    assert math.isclose(sum(outcomes), 1) and head < 0


def plain_score(mixer, symbols):
    """One document, token by token and decision by decision."""
    code, mask = mixer.code, 2**32 - 1
    names = [int(x) for x in code.hash]

    def slot(context, node):
        x = (context + node * 0xC2B2AE35) & mask
        x ^= x >> 15
        return ((x * 0x2C1B3C6D) & mask) >> (32 - L.TABLE_BITS)

    weights = mixer.weights.copy()
    seen, ones, total, at = {}, {}, 0.0, 0
    while at < len(symbols):
        end = min([int(e) for e in L._EARLY if e > at] or [(at // L.SEGMENT + 1) * L.SEGMENT])
        steps, change, counts, told = [], np.zeros_like(weights), {}, []
        for k in range(at, min(end, len(symbols))):
            s = int(symbols[k])
            contexts, mixed = [], 0
            for order in range(1, L.ORDERS + 1):
                before = names[int(symbols[k - order])] if k >= order else names[-1]
                mixed = ((mixed * 0x9E3779B1) & mask) ^ before
                mixed ^= mixed >> 15
                contexts.append((mixed * 0x85EBCA6B + order) & mask)
            total += code.rest[s]
            for d in range(int(code.length[s])):
                node, bit = int(code.nodes[s, d]), int(code.bits[s, d])
                x, gate = [code.static[node]], 0
                for order, c in enumerate(contexts):
                    found = int(mixer.tables[order][slot(c, node)])
                    gate = gate * 4 + (found & 3)
                    x.append((found >> 2) / 256)
                p = 1 / (1 + math.exp(-code.static[node]))
                n, n1 = seen.get(node, 0), ones.get(node, 0)
                x += [math.log((n1 + 4 * p) / (n - n1 + 4 * (1 - p))) if n else 0.0, 1.0]
                z = sum(w * v for w, v in zip(weights[gate], x, strict=True))
                q = 1 / (1 + math.exp(-z))
                total += math.log(q if bit else 1 - q)
                steps.append((gate, bit - q, x))
                counts[gate] = counts.get(gate, 0) + 1
                told.append((node, bit))
        for gate, error, x in steps:
            change[gate] += L.RATE / math.sqrt(counts[gate]) * error * np.array(x)
        weights += change
        for node, bit in told:
            seen[node], ones[node] = seen.get(node, 0) + 1, ones.get(node, 0) + bit
        at = end
    return total


def test_scores_equal_a_plain_mixer():
    rng = np.random.default_rng(12)
    words = [(b"w%d" % k, int(4000 / (k + 1)) + 2) for k in range(3000)]
    code = L.Code(words, 40, 90)
    docs = [np.append(rng.zipf(1.3, n) % 3001, code.end) for n in (0, 1, 9, 130, 300)]
    docs = [np.where(d == 3000, code.escape, d) for d in docs]
    mixer = L.Mixer(code, L.count_tables(code, iter(docs * 2)))
    mixer.calibrate(docs)
    assert np.allclose(mixer.score(docs), [plain_score(mixer, d) for d in docs], rtol=1e-6)


def repeated(rng, sizes):
    """Documents with runs of expected tokens, some of them wrong, and gaps between."""
    codes = [rng.integers(0, 4, n) for n in sizes]
    expected = [np.where(rng.random(n) < rng.random(), np.where(rng.random(n) < 0.8, c, rng.integers(0, 4, n)), -1) for n, c in zip(sizes, codes)]
    return expected, codes


def test_repeats_told_together_are_those_told_alone():
    rng = np.random.default_rng(21)
    for sizes in ([], [0], [1], [700], [5, 5, 5], [0, 900, *rng.integers(0, 60, 80), 4000]):
        expected, codes = repeated(rng, sizes)
        if len(sizes) == 3:
            expected[1][:] = -1
        totals, hits = L.told_together(expected, codes)
        alone = [L.told(e, c) for e, c in zip(expected, codes)]
        assert np.allclose(totals, [t for t, _ in alone], rtol=1e-12)
        assert all((a == b).all() for a, (_, b) in zip(hits, alone, strict=True))


def test_repeats_of_many_documents_take_less_time_together():
    expected, codes = repeated(np.random.default_rng(22), [150] * 400)

    def seconds(f):
        took = []
        for _ in range(3):
            begin = time.process_time()
            f()
            took.append(time.process_time() - begin)
        return min(took)

    assert seconds(lambda: L.told_together(expected, codes)) < 0.6 * seconds(lambda: [L.told(e, c) for e, c in zip(expected, codes)])
