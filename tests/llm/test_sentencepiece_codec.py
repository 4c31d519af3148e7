import random
import zlib

import numpy as np
import pytest

from docengine.llm import sentencepiece_codec as S

C = S.Codec(S.model_path())
TEXTS = ["plain words, and more of them", "oneverylongwordwithoutanyblankinitatall" * 5, "a  b   c    d" * 6, "ü漢字é" * 30,
         "thethethethethethe the the thethe", "\n\n\t x \n y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345 678.90", " lead and trail ", "x"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 20, 64])
def test_scan_equals_the_library(chunk):
    for text in TEXTS:
        assert S.scan_encode(C, text, chunk) == C.model.encode(text), (text, chunk)


def test_random_texts():
    rng = random.Random(5)
    for k in range(150):
        text = "".join(rng.choice("abcdetnoi  rs\nüé12.") for _ in range(rng.randint(1, 90)))
        assert S.scan_encode(C, text, rng.randint(1, 40)) == C.model.encode(text), text


def test_product_is_associative():
    full = S.marked("therethe other thing")
    parts = [(full[max(0, a - C.longest) : a], full[a : a + 5], full[a + 5 :][: C.longest]) for a in range(0, len(full), 5)]
    m = [S.transfer(C, *p) for p in parts]
    assert S.combine(S.combine(m[0], m[1]), m[2]) == S.combine(m[0], S.combine(m[1], m[2]))


@pytest.mark.parametrize("chunk", [3, 20, 1000])
def test_matrix_holds_the_scores_of_all_pieces(chunk):
    for text in [*TEXTS, "several words in the middle of a chunk, ü too " * 4]:
        full = S.marked(text)
        parts = [(full[max(0, a - C.longest) : a], full[a : a + chunk], full[a + chunk :][: C.longest]) for a in range(0, len(full), chunk)]
        whole = S.reduce(S.combine, [S.transfer(C, *p) for p in parts])
        want = sum(C.score.get(C.model.id_to_piece(i), 0.0) for i in C.model.encode(text))
        assert set(S._onwards({("", 0): 0.0}, whole).values()) == {want}, (text, chunk)


def test_documents(spark):
    texts = [None, "", *TEXTS, "word and another one " * 300, "nowhitespace" * 100]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for chunk in (50, 1 << 15):
        got = {r.doc_id: r for r in S.encode(docs, S.model_path(), chunk).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = C.model.encode(t or "")
            assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
            assert got[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<i4").tobytes())
            assert got[i].round_trip, t
    back = {r.doc_id: r.text for r in S.decode(S.encode(docs, S.model_path(), 50), S.model_path()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert S.encode(docs.limit(0), S.model_path()).count() == 0
