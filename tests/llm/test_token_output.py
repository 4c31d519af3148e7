import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docengine.llm import token_output as T

PATH = public_tokenizers.path(T.TOKENIZER)


def brute(rows, end=2):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_tokenizer(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in T.query(spark, sf).collect()) == brute(rows)


def test_odd_texts_and_split_documents(spark):
    texts = [None, "", " ", "  two  blanks ", "a\n b\n\n c \n", "tab\t x", "can't  we'll", "　wide   nbsp", "<|endoftext|> x",
             " lead", "nul\x00 x", "x\x1c y", "e " * 5000, "ü漢 字 é" * 50]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, data string")
    for size in (1 << 20, 64):
        got = T.read_digests(T.write_segments(docs, PATH, segment_ids=size, partitions=3)).collect()
        assert sorted(tuple(r) for r in got) == brute(rows)
    assert T.read_digests(T.write_segments(docs.limit(0), PATH)).count() == 0


def test_repeated_and_null_ids_of_split_documents(spark):
    big, text = "word " * 90, "x"
    rows = [(7, big), (7, big), (8, text), (None, big), (None, big), (7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (64, 100, 1 << 20):
        got = T.read_digests(T.write_segments(docs, PATH, segment_ids=size, partitions=2)).collect()
        assert sorted(r.start for r in got) == sorted({r.start for r in got})
        assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
        counted = lambda x: sorted(x, key=str)
        assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == counted((a, c, d) for a, _, c, d in brute(rows))
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == [None, None, 7, 7, 7, 8]


def test_encoder_equals_the_tokenizer_on_random_marks():
    rng, tokenizer, words = np.random.default_rng(5), Tokenizer.from_file(PATH), T._Pieces(PATH)
    parts = ["a", "It's", "word", "é", "ça", "×", "\u00a0", "\u2003", "\u3000", "漢", " ", " ", " ", "\n", "\t", ",", ".", "!", "'", "9", "\x00", "\x85", "long" * 9, "“", "🙂"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)]
    for text, (ids, last) in zip(texts, T.encode_texts((t.encode() for t in texts), words), strict=True):
        assert last and ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(T, "SLICE_BYTES", 200)
    monkeypatch.setattr(T, "PIECES_AT_ONCE", 16)
    monkeypatch.setattr(T, "CACHE_WORDS", 40)
    text = " ".join(f"w{k * k % 997} é, x" for k in range(400))
    got = list(T.encode_texts(iter([text.encode(), b"b"]), T._Pieces(PATH)))
    ends = [k for k, (_, last) in enumerate(got) if last]
    ids = np.concatenate([x for x, _ in got[: ends[0] + 1]]).tolist()
    assert len(ends) == 2 and ends[0] > 5
    assert ids == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 32])
def test_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 7, 4095, 4096, 4097, 30_000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        if n > 5:
            ids[2:5] = 2**32 - 1
        docs = np.split(ids, sorted(rng.integers(0, n + 1, 3)))
        data = T.encode_segment(docs)
        assert [d.tolist() for d in T.decode_segment(data)] == [d.tolist() for d in docs]
        for b in range(-(-n // T.BLOCK_IDS)):
            assert (T.decode_block(data, b) == ids[b * T.BLOCK_IDS :][: T.BLOCK_IDS]).all()
