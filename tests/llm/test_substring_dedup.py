import hashlib
import random

import pytest

from docengine.llm import substring_dedup as S


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in S.query(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 100), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abc dé") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(50, "ab" * 300), (51, "x" * 500), (52, "ba" * 200), (53, None), (54, ""), (None, parts[0] * 9), (7, rows[7][1]), (7, "x" * 90)]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, doc int")
    got = [tuple(r) for r in S.remove_repeats(docs, length=20, gram=8).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 20), key=key)


def test_empty_table_and_kept_text(spark):
    docs = spark.createDataFrame([(1, "q" * 150), (2, "q" * 150)], "doc_id long, text string")
    assert S.remove_repeats(docs.limit(0)).count() == 0
    got = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(docs, with_text=True).collect()}
    assert got == {1: b"q", 2: b""}  # the first string stays only where no later one covers it


def test_long_documents_in_pieces():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef ") for _ in range(4000)).encode()
    import numpy as np

    data = np.frombuffer(text, np.uint8)
    whole = S.anchors(data, 100, 32)
    covered = sorted((int(a), int(b)) for a, b in zip(whole[1], whole[2]))
    assert covered[0][0] == 0 and covered[-1][1] == len(text) - 100
    assert all(b + 1 == a for (_, b), (a, _) in zip(covered, covered[1:]))


def test_regions_of_one_gram_that_share_32_bits_of_their_digest(spark):
    import numpy as np
    import xxhash

    rng = random.Random(8)
    head = "".join(rng.choice("abcdefghij") for _ in range(80))
    texts = [head + "".join(rng.choices("klmnopqrst", k=20)) for _ in range(200_000)]
    low = np.array([xxhash.xxh3_64_intdigest(t) & 0xFFFFFFFF for t in texts], dtype=np.uint32)
    order = np.argsort(low, kind="stable")
    pairs = [(texts[i], texts[j]) for i, j in zip(order, order[1:]) if low[i] == low[j] and texts[i] != texts[j]]
    gram = lambda t: int(S.anchors(np.frombuffer(t.encode(), np.uint8))[0][0])
    one, two = next((a, b) for a, b in pairs if gram(a) == gram(b))
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert [r.n_removed for r in S.remove_repeats(docs).collect()] == [0, 0]
