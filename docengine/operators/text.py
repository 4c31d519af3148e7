"""Full-text search: postings as a table, BM25 as a sum over the query's terms.

``FulltextIndex`` searches a table of documents as it is. ``StoredIndex`` keeps the
postings as files in buckets of terms, so a search reads the buckets of its terms and no text;
it follows changes by adding what is new.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docengine.functions.mango import compile_selector

K1, B = 1.2, 0.75
BUCKETS = 64


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens_with_bigrams(text: Column) -> Column:
    """For texts without blanks between words: single ideographs and pairs of them as well."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?=(\p{IsHan}\p{IsHan}))"), F.lit(1))
    return F.concat(tokens(text), F.regexp_extract_all(text, F.lit(r"\p{IsHan}"), F.lit(0)), pairs)


def query_terms(text: str, min_length: int = 0, stop_words: tuple[str, ...] = ()) -> list[str]:
    """Split at white space, lower-cased; short ones (in bytes) and stop words dropped; the analyser's words of the rest."""
    import re

    kept = [w for w in text.lower().split() if len(w.encode()) >= min_length and w not in stop_words]
    return sorted({t for w in kept for t in re.findall(r"\w+", w)})


class FulltextIndex:
    """(term, id, tf, length) of all documents with a text; what a search reads of it is its terms' part."""

    def __init__(self, df: DataFrame, id_col: str, text: Column | str, analyzer=tokens, min_length: int = 0, stop_words: tuple[str, ...] = ()):
        self.df, self.id, self.min_length, self.stop_words = df, id_col, min_length, stop_words
        text = F.col(text) if isinstance(text, str) else text
        self.words = df.select(F.col(id_col).alias("id"), analyzer(F.coalesce(text, F.lit(""))).alias("words")).filter(F.size("words") > 0)

    def postings(self) -> DataFrame:
        rows = self.words.select("id", F.size("words").alias("length"), F.explode("words").alias("term"))
        return rows.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))

    def count(self) -> int:
        return self.words.count()

    def persist(self, path: str) -> None:
        self.postings().write.mode("overwrite").parquet(path)

    def scores(self, query: str, selector: dict | None = None) -> DataFrame:
        """(id, raw) of the documents with at least one term; the statistics are of all documents.

        The query's terms are filtered before anything is exploded, so only their
        postings are shuffled.
        """
        terms = query_terms(query, self.min_length, self.stop_words)
        wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
        stats = self.words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
        hits = self.words.select("id", F.size("words").alias("length"), F.explode(F.filter("words", lambda w: F.array_contains(wanted, w))).alias("term"))
        out = _bm25(hits.groupBy("term", "id", "length").agg(F.count("*").alias("tf")), stats)
        return _selected(out, self.df, self.id, selector)

    def search(self, query: str, limit: int = 10, threshold: float = 0.0, selector: dict | None = None) -> DataFrame:
        """(id, score): the best first with the score over the best one's; the threshold is applied to these."""
        return _best(self.scores(query, selector), limit, threshold)


def _bm25(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, raw) from (term, id, length, tf) of a query's terms and one row (n, mean)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    rows = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.withColumn("w", weight).groupBy("id").agg(F.sum("w").alias("raw"))


def _selected(scores: DataFrame, df: DataFrame, id_col: str, selector: dict | None) -> DataFrame:
    if not selector:
        return scores
    return scores.join(df.filter(compile_selector(df, selector)).select(F.col(id_col).alias("id")), "id", "left_semi")


def _best(scores: DataFrame, limit: int, threshold: float) -> DataFrame:
    top = scores.withColumn("raw", F.round("raw", 9)).orderBy(F.desc("raw"), "id").limit(limit)
    best = F.max("raw").over(Window.partitionBy(F.lit(0)))  # over the rows that are left, ``limit`` at most
    out = top.select("id", (F.col("raw") / best).alias("score")).orderBy(F.desc("score"), "id")
    return out.filter(F.col("score") >= threshold) if threshold else out


class StoredIndex:
    """Postings (term, id, length, tf, gen) in buckets of terms, and (id, gen, length, alive) of each indexing of a document.

    A document that changes or goes is added again under a higher generation; a posting counts
    if its generation is the document's last. ``compact`` leaves the last ones alone.
    """

    def __init__(self, spark: SparkSession, path: str, analyzer: Callable[[Column], Column] = tokens, min_length: int = 0, stop_words: tuple[str, ...] = ()):
        self.spark, self.path, self.analyzer = spark, path.rstrip("/"), analyzer
        self.min_length, self.stop_words = min_length, stop_words

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text: Column | str, path: str, **more) -> StoredIndex:
        """Index all documents that have a text."""
        out = cls(df.sparkSession, path, **more)
        text = F.col(text) if isinstance(text, str) else text
        out._add(df.select(F.col(id_col).alias("id"), text.alias("text")).filter("text is not null"), 0, "overwrite")
        return out

    def _add(self, rows: DataFrame, gen: int, mode: str) -> None:
        words = rows.select("id", self.analyzer(F.coalesce("text", F.lit(""))).alias("words"))
        length = F.size("words")
        words.select("id", F.lit(gen).cast("long").alias("gen"), length.alias("length"), (length > 0).alias("alive")).write.mode(mode).parquet(f"{self.path}/documents")
        each = words.select("id", length.alias("length"), F.explode("words").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
        bucket = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int")
        each = each.withColumn("gen", F.lit(gen).cast("long")).withColumn("bucket", bucket)
        each.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        """(id, gen, length) of the documents that are indexed now."""
        rows = self.spark.read.parquet(f"{self.path}/documents")
        last = rows.groupBy("id").agg(F.max_by(F.struct("gen", "length", "alive"), "gen").alias("x"))
        return last.select("id", "x.*").filter("alive").drop("alive")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """Postings that count, of some terms or of all."""
        rows = self.spark.read.parquet(f"{self.path}/postings")
        if terms is not None:
            buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
            rows = rows.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return rows.drop("bucket").join(self.documents().select("id", "gen"), ["id", "gen"], "left_semi").drop("gen")

    def count(self) -> int:
        return self.documents().count()

    def refresh(self, changes: DataFrame) -> None:
        """Follow changes (id, text): a text is indexed anew, null takes the document out."""
        gen = self.spark.read.parquet(f"{self.path}/documents").agg(F.max("gen")).first()[0]
        self._add(changes.select("id", "text"), (gen or 0) + 1, "append")

    def follow(self, feed: str, checkpoint: str, field: str, kind: str = "string", once: bool = True):
        """Keep up with a log of changes: of each document's last change the field's text, or its end."""
        from docengine.streaming import changes

        def run(batch: DataFrame, _: int) -> None:
            last = batch.groupBy("id").agg(F.max_by(F.struct("op", "doc"), "seq").alias("x"))
            text = F.when(F.col("x.op") != "delete", F.get_json_object("x.doc", f"$.{field}"))
            if not last.isEmpty():
                self.refresh(last.select(F.col("id").cast(kind).alias("id"), text.alias("text")))

        return changes.follow(self.spark, feed, checkpoint, run, once)

    def compact(self, path: str) -> StoredIndex:
        """The index in another folder, without what does not count any more."""
        out = StoredIndex(self.spark, path, self.analyzer, self.min_length, self.stop_words)
        self.documents().withColumn("gen", F.lit(0).cast("long")).withColumn("alive", F.lit(True)).write.mode("overwrite").parquet(f"{out.path}/documents")
        bucket = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int")
        rows = self.postings().withColumn("gen", F.lit(0).cast("long")).withColumn("bucket", bucket)
        rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{out.path}/postings")
        return out

    def scores(self, query: str, selector: dict | None = None, df: DataFrame | None = None, id_col: str = "id") -> DataFrame:
        """(id, raw) as of ``FulltextIndex``; a selector needs the documents ``df``."""
        stats = self.documents().agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        out = _bm25(self.postings(query_terms(query, self.min_length, self.stop_words)), stats)
        return _selected(out, df, id_col, selector)

    def search(self, query: str, limit: int = 10, threshold: float = 0.0, selector: dict | None = None, df: DataFrame | None = None, id_col: str = "id") -> DataFrame:
        return _best(self.scores(query, selector, df, id_col), limit, threshold)


def weighted_hybrid(text: DataFrame, vector: DataFrame, limit: int, text_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """Weighted sum of the scores of two result lists (id, score); what a side lacks counts zero there."""
    a, b = text.select("id", F.col("score").alias("ts")), vector.select("id", F.col("score").alias("vs"))
    both = a.join(b, "id", "full_outer").fillna(0.0, ["ts", "vs"])
    return both.select("id", F.round(text_weight * F.col("ts") + vector_weight * F.col("vs"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def reciprocal_ranks(lists: list[DataFrame], limit: int, constant: int = 60) -> DataFrame:
    """(id, score) of the sum of 1 / (rank + constant) over ranked lists (id, rank from 0)."""
    out = None
    for one in lists:
        part = one.select("id", (1 / (F.col("rank") + constant)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.round(F.sum("s"), 12).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
