"""Texts to sentences and chunks. Sequential within a document, parallel over documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.session import ship_code

_HEADER = re.compile(r"^#{1,6}\s")
_ENDS = ".!?。！？"


def sentences(text: str) -> list[str]:
    """Pieces that end at ``.!?。！？`` or a line's end; a Markdown header is one of its own; stray marks go to the piece before."""
    out: list[str] = []
    for line in re.split(r"[\n\r]+", text or ""):
        line = line.strip()
        if not line:
            continue
        if _HEADER.match(line):
            out.append(line)
            continue
        for piece in re.findall(rf"[^{_ENDS}]*[{_ENDS}]+|[^{_ENDS}]+$", line):
            piece = piece.strip()
            if piece and not piece.strip(_ENDS + " ") and out:
                out[-1] += piece
            elif piece:
                out.append(piece)
    return out


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def similarities(parts: list[str]) -> list[float]:
    """TF-IDF cosine of each sentence with the next: tf = count / length, idf = ln((1 + N) / (1 + df)) + 1."""
    counts = [Counter(_words(p)) for p in parts]
    df = Counter(w for c in counts for w in c)
    by_df = {d: math.log((1 + len(parts)) / (1 + d)) + 1 for d in set(df.values())}
    idf = {w: by_df[d] for w, d in df.items()}
    # a sentence's length scales its whole vector, so it does not matter to the cosine
    vectors = [{w: k * idf[w] for w, k in c.items()} for c in counts]
    sizes = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    out = []
    for k in range(len(vectors) - 1):
        a, b = sorted(vectors[k : k + 2], key=len)
        size = sizes[k] * sizes[k + 1]
        out.append(sum(x * b[w] for w, x in a.items() if w in b) / size if size else 0.0)
    return out


def chunks(text: str, threshold: float = 0.2, max_sentences: int = 10, min_chars: int = 0) -> list[str]:
    """Sentences put together until a header comes, the next is unlike, or there are enough; always cut at twice that."""
    parts = sentences(text)
    near = similarities(parts)
    out: list[list[str]] = []
    for k, part in enumerate(parts):
        if out:
            own = out[-1]
            wish = bool(_HEADER.match(part)) or near[k - 1] < threshold or len(own) >= max_sentences
            if not (wish and sum(map(len, own)) >= min_chars) and len(own) < 2 * max_sentences:
                own.append(part)
                continue
        out.append([part])
    return ["\n".join(x) for x in out]


def _exploded(df: DataFrame, id_col: str, text_col: str, f: Callable[[str], list[str]], name: str) -> DataFrame:
    ship_code(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, p) for i, t in zip(pdf["id"], pdf["text"], strict=True) for k, p in enumerate(f(t))]
            yield pd.DataFrame(rows, columns=["id", "seq", name])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInPandas(run, f"id {kind}, seq int, {name} string")


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _exploded(df, id_col, text_col, sentences, "sentence")


def split_chunks(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.2, max_sentences: int = 10, min_chars: int = 0) -> DataFrame:
    return _exploded(df, id_col, text_col, lambda t: chunks(t, threshold, max_sentences, min_chars), "chunk")


def without_white_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def chunk_id(id_col: Column, seq: Column) -> Column:
    return F.concat_ws("_", id_col.cast("string"), seq.cast("string"))
