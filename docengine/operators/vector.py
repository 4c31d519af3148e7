"""Vector search: distances as JVM expressions, top-k by Spark's own operators.

``VectorIndex`` is exact. ``InvertedLists`` keeps vectors in files by their nearest centre and reads
the lists of the centres nearest to a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docengine.functions.mango import compile_selector

METRICS = ("cosine", "l2", "dot")
_MAX = 1.7976931348623157e308
BLOCK_QUERIES = 4096


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero if a norm is zero or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "l2":
        gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.when(F.size(a) == F.size(b), F.sqrt(_sum(gap))).otherwise(F.lit(_MAX))
    if metric == "dot":
        return F.when(F.size(a) == F.size(b), -dot(a, b)).otherwise(F.lit(_MAX))
    raise ValueError(f"unknown metric {metric}")


def score(d: Column, metric: str = "cosine") -> Column:
    return {"cosine": 1 - d / 2, "l2": 1 / (1 + d), "dot": 1 / (1 + F.exp(d))}.get(metric, 1 - d)


def score_to_distance(s: Column) -> Column:
    """The distance of a score 1 / (1 + d * d): that is the score of nearest-neighbour indexes, whatever the metric."""
    square = 1 / s - 1
    return F.when(s > 0, F.when(square < 0, 0.0).otherwise(F.sqrt(square))).otherwise(F.lit(_MAX))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


class VectorIndex:
    """Vectors of one length and metric, in a table that stays what it is; others are left out."""

    def __init__(self, df: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int | None = None, metric: str = "cosine", partition: str | None = None):
        self.id, self.vec, self.metric, self.partition = id_col, vec_col, metric, partition
        self.df = df.filter(F.size(vec_col) == dim) if dim else df.filter(F.col(vec_col).isNotNull())

    def _measured(self, query: Column, df: DataFrame | None = None) -> DataFrame:
        rows = (self.df if df is None else df).withColumn("distance", F.round(distance(F.col(self.vec), query, self.metric), 12))
        return rows.withColumn("score", score(F.col("distance"), self.metric))

    def search(self, query: list[float], limit: int | None = None, max_distance: float = 0, min_score: float | None = None, selector: dict | None = None, partition: object = None) -> DataFrame:
        """Nearest first, ties by id; all rows without a limit. The selector and the partition are applied before any distance."""
        rows = self.df
        if partition is not None and self.partition:
            rows = rows.filter(F.col(self.partition) == F.lit(partition))
        if selector:
            rows = rows.filter(compile_selector(rows, selector))
        rows = self._measured(_literal(query), rows)
        if max_distance:
            rows = rows.filter(F.col("distance") <= max_distance)
        if min_score is not None:
            rows = rows.filter(F.col("score") >= min_score)
        rows = rows.orderBy("distance", self.id)
        return rows.limit(limit) if limit is not None else rows

    def knn(self, query: list[float], k: int = 10) -> DataFrame:
        return self.search(query, limit=k)

    def range(self, query: list[float], max_distance: float) -> DataFrame:
        return self.search(query, max_distance=max_distance)

    def batch(self, queries: DataFrame, query_id: str, query_vec: str, k: int, block: int = BLOCK_QUERIES) -> DataFrame:
        """The k nearest for each row of a stated set of queries.

        The queries are sent to the vectors in blocks of about ``block`` rows, so what is broadcast at a
        time is bounded; each block keeps its k nearest before anything is shuffled.
        """
        rows = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("_q"))
        n = max(1, -(-rows.count() // block))
        out = None
        for at in range(n):
            some = rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == at) if n > 1 else rows
            pairs = self.df.join(F.broadcast(some))
            near = pairs.withColumn("distance", F.round(distance(F.col(self.vec), F.col("_q"), self.metric), 12))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", self.id))
            near = near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_q")
            out = near if out is None else out.unionByName(near)
        return out

    def by_document(self, doc: dict, embed: Callable[[dict], list[float]], limit: int | None = None, **more) -> DataFrame:
        """As ``search`` for a document that need not be stored; its stored vector is taken if it has one."""
        stored = self.get(doc[self.id]) if self.id in doc else None
        return self.search(embed(doc) if stored is None else stored, limit, **more)

    def by_id(self, doc_id: object, k: int) -> DataFrame:
        """Neighbours of a stored vector: the k nearest without itself, so one less."""
        row = self.df.filter(F.col(self.id) == F.lit(doc_id)).select(self.vec).first()
        if row is None:
            raise KeyError(doc_id)
        return self.search(list(row[0]), limit=k).filter(F.col(self.id) != F.lit(doc_id))

    def similarity_matrix(self, ids: list) -> DataFrame:
        """(a, b, similarity) for a stated list of ids; one on the diagonal, zero for unknown ids."""
        spark = self.df.sparkSession
        kind = dict(self.df.dtypes)[self.id]
        named = spark.createDataFrame([(i,) for i in ids], f"i {kind}")
        rows = F.broadcast(named).join(self.df.select(F.col(self.id).alias("i"), F.col(self.vec).alias("v")), "i", "left")
        a, b = rows.select(F.col("i").alias("a"), F.col("v").alias("va")), rows.select(F.col("i").alias("b"), F.col("v").alias("vb"))
        same = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(score(1 - cosine_similarity(F.col("va"), F.col("vb")), "cosine"), F.lit(0.0)))
        known = F.col("va").isNotNull() & F.col("vb").isNotNull()
        return a.join(F.broadcast(b)).select("a", "b", F.when(known | (F.col("a") == F.col("b")), same).otherwise(0.0).alias("similarity"))

    def get(self, doc_id: object) -> list[float] | None:
        row = self.df.filter(F.col(self.id) == F.lit(doc_id)).select(self.vec).first()
        return list(row[0]) if row else None

    def with_embedding(self, doc_id: object, vector: list[float]) -> VectorIndex:
        kind = self.df.schema[self.vec].dataType
        hit = F.col(self.id) == F.lit(doc_id)
        return VectorIndex(self.df.withColumn(self.vec, F.when(hit, _literal(vector).cast(kind)).otherwise(F.col(self.vec))), self.id, self.vec, None, self.metric, self.partition)

    def count(self) -> int:
        return self.df.count()

    def persist(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine", partition: str | None = None) -> VectorIndex:
        return cls(spark.read.parquet(path), id_col, vec_col, None, metric, partition)

    def reindex(self, df: DataFrame) -> VectorIndex:
        return VectorIndex(df, self.id, self.vec, None, self.metric, self.partition)


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of a sample by Lloyd's rounds; an empty one is put on the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    out = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        gap = (sample**2).sum(1)[:, None] - 2 * sample @ out.T + (out**2).sum(1)
        own = gap.argmin(1)
        for c in range(len(out)):
            mine = own == c
            out[c] = sample[mine].mean(0) if mine.any() else sample[gap[np.arange(len(sample)), own].argmax()]
    return out


class InvertedLists:
    """Approximate search: every vector is in the list of its nearest centre; a search reads ``probes`` lists and is exact in these.

    Centres are fitted on at most ``SAMPLE`` vectors. For the cosine vectors are normalised first.
    """

    SAMPLE = 20_000

    def __init__(self, spark: SparkSession, path: str, found: np.ndarray, id_col: str, vec_col: str, metric: str):
        self.spark, self.path, self.centres, self.id, self.vec, self.metric = spark, path, found, id_col, vec_col, metric

    @classmethod
    def build(cls, index: VectorIndex, path: str, lists: int = 64) -> InvertedLists:
        spark, vec, metric = index.df.sparkSession, index.vec, index.metric
        n = max(index.df.count(), 1)
        share = min(1.0, cls.SAMPLE / n)
        some = index.df.filter(F.pmod(F.xxhash64(index.id), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(vec).limit(cls.SAMPLE)
        sample = np.array([r[0] for r in some.collect()], dtype=float).reshape(-1, len(index.df.select(vec).first()[0]) if n else 1)
        found = centres(_unit(sample, metric), min(lists, len(sample)))
        out = cls(spark, path.rstrip("/"), found, index.id, vec, metric)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.array(batch.column(vec).to_pylist(), dtype=float).reshape(batch.num_rows, found.shape[1])
                gap = (found**2).sum(1) - 2 * _unit(own, metric) @ found.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gap.argmin(1).astype(np.int32))], [*batch.schema.names, "list"])

        fields = ", ".join(f"`{c}` {k}" for c, k in index.df.dtypes)
        rows = index.df.mapInArrow(assign, f"{fields}, list int")
        rows.repartition("list", F.pmod(F.xxhash64(index.id), F.lit(4))).write.mode("overwrite").partitionBy("list").parquet(f"{out.path}/lists")
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(found)], "list int, centre array<double>").write.mode("overwrite").parquet(f"{out.path}/centres")
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine") -> InvertedLists:
        rows = sorted(spark.read.parquet(f"{path.rstrip('/')}/centres").collect())  # as many as there are lists
        return cls(spark, path.rstrip("/"), np.array([r.centre for r in rows]), id_col, vec_col, metric)

    def search(self, query: list[float], limit: int = 10, probes: int = 8) -> DataFrame:
        own = _unit(np.array([query], dtype=float), self.metric)[0]
        gap = ((self.centres - own) ** 2).sum(1) if self.metric != "dot" else -(self.centres @ own)
        near = [int(k) for k in np.argsort(gap, kind="stable")[:probes]]
        rows = self.spark.read.parquet(f"{self.path}/lists").filter(F.col("list").isin(near)).drop("list")
        return VectorIndex(rows, self.id, self.vec, None, self.metric).search(query, limit)


def _unit(rows: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return rows
    size = np.sqrt((rows**2).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1)
