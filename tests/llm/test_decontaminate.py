import numpy as np

from docengine.llm import decontaminate as D


def brute(words, items, threshold, overlap, width):
    """Every passage against every item, BM25 spelt out."""
    own = {i: D.words_of(t) for i, t in items}
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    df = {}
    for w in own.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1

    def part(x, w):
        c = w.count(x)
        return np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean))

    out, step = {}, width // 2
    for at in range(0, max(len(words) - step, 1), step):
        passage = words[at : at + width]
        near = words[max(0, at - step) : at + width + step]
        grams = {tuple(near[i : i + 5]) for i in range(len(near))}
        for i, w in own.items():
            score = sum(part(x, w) for x in set(w) & set(passage)) / sum(part(x, w) for x in set(w))
            if score < threshold - 1e-9:
                continue
            shares = []
            for half in (w[: len(w) // 2], w[len(w) // 2 :]):
                s = {tuple(half[k : k + 5]) for k in range(len(half) - 4)}
                shares.append(len(s & grams) / len(s))
            if min(shares) >= overlap and score > out.get(i, (0,))[0]:
                out[i] = (score, *shares)
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r[0], r[1].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert max(len(D.words_of(t)) for _, t in items) <= D.ITEM_WORDS
    width = 2 * D.ITEM_WORDS
    want = {(d, i): v for d, t in docs for i, v in brute(D.words_of(t.encode()), items, D.THRESHOLD, D.OVERLAP, width).items()}
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in D.query(spark, sf).collect()}
    assert set(got) == set(want) and want
    for k in want:
        assert np.allclose(got[k], want[k])


def test_edges_and_planted(spark):
    item = " ".join(f"word{i} filler{i % 3}" for i in range(20))
    clean = " ".join(f"other{i}" for i in range(400))
    rows = [(1, None), (2, ""), (3, clean), (4, f"{clean} {item.upper()}! {clean}"), (4, item), (None, item), (7, item[: len(item) // 2])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item, "q"), (1, item, "q"), (2, None, "q"), (3, clean + " more", "q")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or 0, r.item_id) for r in D.matches(docs, bench).collect())
    # item 3 is the clean filler itself, so documents 3 and the long 4 hold it
    want = [(0, 1)] * 2 + [(3, 3)] + [(4, 1)] * 4 + [(4, 3)]
    assert got == want
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {1, 2, 7}
    assert D.matches(docs.limit(0), bench).count() == 0
    assert D.matches(docs, bench.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.item_id) for r in D.matches(docs, bench, block_items=1).collect()) == want


def test_blocks_of_items_score_alike(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {(r.doc_id, r.item_id): r.score for r in D.matches(docs, bench).collect()}
    many = {(r.doc_id, r.item_id): r.score for r in D.matches(docs, bench, block_items=9).collect()}
    assert set(one) == set(many) and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_an_item_is_found_alike_beside_longer_ones(spark):
    halves = [" ".join(f"{h}{i}" for i in range(10)) for h in "qa"]
    long = " ".join(f"long{i}" for i in range(200))
    apart = f"{halves[0]} {' '.join(f'x{i}' for i in range(150))} {halves[1]}"
    rows = [("a", apart), ("b", " ".join(halves)), ("c", f"{long} {' '.join(halves)}"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    items = [("i", " ".join(halves)), ("j", long), ("k", " ".join(halves) + " z"), (None, "unseen words only here")]
    alone = None
    for some in (items[:1], items[:2], items):
        for size in (1, 2, 100):
            bench = spark.createDataFrame(some, "item_id string, text string")
            got = {(r.doc_id, r.item_id) for r in D.matches(docs, bench, block_items=size).collect()}
            mine = {x for x in got if x[1] == "i"}
            alone = mine if alone is None else alone
            assert mine == alone == {("b", "i"), ("c", "i")}
            assert len(some) == 1 or {("c", "j"), (None, "j")} <= got


def test_cursors_find_what_all_scores_give():
    rng = np.random.default_rng(4)
    texts = [b" ".join(b"t%d" % k for k in rng.zipf(1.3, 30) % 60) for _ in range(150)]
    words = [D.words_of(t) for t in texts]
    df = {}
    for own in words:
        for w in set(own):
            df[w] = df.get(w, 0) + 1
    index = D.Index(list(enumerate(texts)), (len(texts), sum(map(len, words)) / len(words), df))
    for k in range(80):
        own = np.unique([index.term[w] for w in words[k][: rng.integers(5, 30)] + words[-k][:5]])
        dense = np.zeros(len(texts))
        for t in own.tolist():
            at = slice(index.starts[t], index.starts[t + 1])
            dense[index.items[at]] += index.impacts[at]
        for threshold in (0.2, 0.5, 0.8):
            got = index.search(own, threshold)
            assert [i for i, _ in got] == np.flatnonzero(dense >= threshold - 1e-9).tolist()
            assert np.allclose([s for _, s in got], dense[[i for i, _ in got]])
