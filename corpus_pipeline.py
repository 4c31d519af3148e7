"""The corpus pipeline: five stages, each one operator, each written before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of documents.

Defined cases, in every stage: a null text counts as empty; rows with a null or repeated doc_id are rows of their own;
an empty table stays empty; further columns pass through whatever they are called (but the last
stage, which returns doc_id and its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docengine.llm import decontaminate, exact_dedup, quality, sentencepiece_codec, simhash_dedup
from docengine.llm.common import load, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine accepts, each by its own text; it learns from the labels of these rows.

    An empty text is scored by its structure; without labels of both classes their share decides for all.
    """
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the most characters, then the smallest doc_id, null last.

    Empty, null and white texts are one group; of rows that are alike in all this any one stays.
    """
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the smallest doc_id, null last, of each component of near copies (five words, similarity 0.8 or more).

    Texts without words are copies of each other; a text of fewer than five words is one shingle.
    """
    return simhash_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item; an empty text holds none, an item without words is held by none."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the rows that are left, with a digest and the round trip's outcome; an empty text has no ids."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.model_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; nothing is collected but what the operators bound."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier and a tokenizer have no equivalent in SQL.
ORACLE_SQL = None
