"""Retrieval for generation: extraction, retrieve modes, answers, adapters."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docengine.errors import QueryFailed
from docengine.functions.mango import compile_selector
from docengine.operators.graph import GraphQuery, edges_of, subgraph
from docengine.operators.text import FulltextIndex, reciprocal_ranks
from docengine.operators.vector import VectorIndex

#: Fixed value: the answer where nothing is found.
NOTHING_FOUND = "No relevant information found."
APPEARS_IN = "APPEARS_IN"


def simple_embedding(text: Column, dims: int = 768) -> Column:
    """Bytes over 255, padded with zeros."""
    pairs = F.regexp_extract_all(F.hex(F.substring(F.encode(text, "UTF-8"), 1, dims)), F.lit("(..)"), F.lit(1))
    numbers = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("double") / 255)
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0.0), dims)), 1, dims)


def simple_embed(text: str, dims: int = 768) -> list[float]:
    data = text.encode()[:dims]
    return [b / 255 for b in data] + [0.0] * (dims - len(data))


def extraction_prompt(text: str) -> str:
    """Asks for the entities and relationships of a text, as JSON in the form that ``extracted_edges`` reads."""
    form = '{"entities": [{"name": "...", "type": "...", "description": "..."}], "relationships": [{"source": "...", "target": "...", "relation": "..."}]}'
    return f"List every entity of the text below and how they relate to each other. Answer in JSON alone, like {form}\n\nText:\n{text}\n"


def query_entities_prompt(query: str) -> str:
    return f'Name the main entities of the query below. Answer with a JSON array of strings alone, like ["A", "B"]\n\nQuery:\n{query}\n'


def answer_prompt(query: str, context: str) -> str:
    return f"Context:\n{context}\nQuestion: {query}\nAnswer:"


class SimpleLLM:
    """Set answers for tests: the first key found in the prompt decides."""

    def __init__(self, answers: dict[str, str] | None = None):
        self.answers = answers or {}

    def complete(self, prompt: str) -> str:
        return next((a for k, a in self.answers.items() if k in prompt), "")


def between_braces(text: str, left: str = "{", right: str = "}") -> object | None:
    """The JSON between the first left and the last right mark."""
    a, b = text.find(left), text.rfind(right)
    try:
        return json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None


def query_entities(llm: SimpleLLM, query: str) -> list[str]:
    """The entities that a model finds in a query; an answer that holds no JSON array of strings is an error."""
    found = between_braces(llm.complete(query_entities_prompt(query)), "[", "]")
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise QueryFailed("the answer holds no list of entities")
    return found


_EXTRACTED = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,relation:string>>>"


def extracted_edges(answers: DataFrame, id_col: str, answer_col: str) -> DataFrame:
    """Edges of the model's answers: entity -APPEARS_IN-> document and source -relation-> target."""
    body = F.regexp_extract(answer_col, r"(?s)(\{.*\})", 1)
    rows = answers.select(F.col(id_col).cast("string").alias("doc"), F.from_json(body, _EXTRACTED).alias("x"))
    one = rows.select(F.explode("x.entities").alias("e"), "doc").select(F.col("e.name").alias("subject"), F.lit(APPEARS_IN).alias("predicate"), F.col("doc").alias("object"))
    two = rows.select(F.explode("x.relationships").alias("r")).select(F.col("r.source").alias("subject"), F.col("r.relation").alias("predicate"), F.col("r.target").alias("object"))
    return one.unionByName(two).filter("subject is not null and predicate is not null and object is not null").distinct()


@dataclass
class Rag:
    """Documents (id, content, embedding, …) with an index of each kind and a graph of entities."""

    docs: DataFrame
    edges: DataFrame | None = None
    embed: Callable[[str], list[float]] = simple_embed
    entities: Callable[[str], list[str]] | None = None
    llm: SimpleLLM = field(default_factory=SimpleLLM)
    metric: str = "cosine"

    def query_entities(self, query: str) -> list[str]:
        """By the callable if there is one, else by the model's answer; none if that is no list."""
        if self.entities:
            return self.entities(query)
        try:
            return query_entities(self.llm, query)
        except QueryFailed:
            return []

    def extract(self, rows: DataFrame) -> DataFrame:
        """Edges that the model finds in documents (id, content), each asked for in its own task."""
        llm = self.llm

        @F.pandas_udf("string")
        def ask(s: pd.Series) -> pd.Series:
            return s.map(lambda x: llm.complete(extraction_prompt(x or "")))

        return extracted_edges(rows.select("id", ask("content").alias("answer")), "id", "answer")

    def _kept(self, filters: dict | None) -> DataFrame:
        return self.docs.filter(compile_selector(self.docs, filters)) if filters else self.docs

    def fulltext(self, query: str, k: int, filters: dict | None = None) -> DataFrame:
        return FulltextIndex(self.docs, "id", "content").search(query, k, selector=filters)

    def vector(self, query: str, k: int, filters: dict | None = None) -> DataFrame:
        return VectorIndex(self._kept(filters), "id", "embedding", None, self.metric).search(self.embed(query), k).select("id", "score")

    def local(self, names: list[str], k: int) -> DataFrame:
        """Documents of the entities and of their neighbours, each with score 1."""
        near = GraphQuery(self.edges.filter(F.col("predicate") != APPEARS_IN)).v(*names).both().all().select(F.col("next").alias("node"))
        spark = self.docs.sparkSession
        nodes = near.union(spark.createDataFrame([(n,) for n in names], "node string")).distinct()
        found = GraphQuery(self.edges).of(nodes).out(APPEARS_IN).all().select(F.col("object").alias("id")).distinct()
        ids = self.docs.select("id").join(found, self.docs["id"].cast("string") == found["id"], "left_semi")
        return ids.select("id", F.lit(1.0).alias("score")).orderBy("id").limit(k)

    def hybrid(self, query: str, k: int, filters: dict | None = None) -> DataFrame:
        ranked = []
        for part in (self.fulltext(query, 2 * k, filters), self.vector(query, 2 * k, filters)):
            rank = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1
            ranked.append(part.select("id", rank.alias("rank")))  # at most 2 k rows
        return reciprocal_ranks(ranked, k)

    def retrieve(self, query: str, mode: str = "hybrid", k: int = 5, filters: dict | None = None, threshold: float | None = None) -> DataFrame:
        """(id, score, …document) of a mode: vector, fulltext, local, graph, global, hybrid; any other is fulltext."""
        if mode == "vector":
            found = self.vector(query, k, filters)
        elif mode in ("local", "graph"):
            names = self.query_entities(query)
            found = self.local(names, k) if names and self.edges is not None else self.fulltext(query, k)
        elif mode in ("hybrid", "global"):
            found = self.hybrid(query, k, filters if mode == "hybrid" else None)
        else:
            found = self.fulltext(query, k, filters if mode == "fulltext" else None)
        if threshold is not None:
            found = found.filter(F.col("score") >= threshold)
        return found.join(self.docs, "id").orderBy(F.desc("score"), "id")

    def answer(self, query: str, mode: str = "hybrid", k: int = 5) -> str:
        rows = self.retrieve(query, mode, k).select("content").collect()  # k rows
        if not rows:
            return NOTHING_FOUND
        context = "".join(f"[{i + 1}] {r.content}\n" for i, r in enumerate(rows))
        return self.llm.complete(answer_prompt(query, context)) or context

    def search_graph(self, names: list[str]) -> DataFrame:
        """Edges at the entities, without where they appear."""
        return GraphQuery(self.edges.filter(F.col("predicate") != APPEARS_IN)).v(*names).both().all().select("subject", "predicate", "object").distinct()

    def get_subgraph(self, node: str, depth: int) -> tuple[DataFrame, DataFrame]:
        return subgraph(self.edges, node, depth)

    def insert(self, rows: DataFrame) -> Rag:
        """With more documents; an id is made of the content where there is none."""
        made = F.sha2("content", 256) if "id" not in rows.columns else F.coalesce(F.col("id"), F.sha2("content", 256))
        rows = rows.filter("content is not null").withColumn("id", made)
        return Rag(self.docs.unionByName(rows, allowMissingColumns=True), self.edges, self.embed, self.entities, self.llm, self.metric)


def index_documents(docs: DataFrame, content: str = "content", dims: int = 768, out: str = "embedding") -> DataFrame:
    """Documents with embeddings, ready to be upserted."""
    return docs.withColumn(out, simple_embedding(F.col(content), dims))


def retrieve_documents(index: VectorIndex, query: list[float], top_k: int = 5, min_score: float | None = None) -> DataFrame:
    return index.search(query, top_k, min_score=min_score)


@dataclass
class Indexer:
    """Stores documents (id, content, …) with their embeddings in a collection, in one write."""

    collection: object
    dims: int = 768
    type: str = "documents"

    def store(self, docs: DataFrame) -> DataFrame:
        """The ids that were stored."""
        rows = index_documents(docs, dims=self.dims)
        self.collection.upsert(rows)
        return rows.select("id")


@dataclass
class Retriever:
    """(id, content, score, distance, …) of the documents nearest to a query."""

    collection: object
    embed: Callable[[str], list[float]] = simple_embed
    top_k: int = 5
    min_score: float | None = None
    metric: str = "cosine"
    type: str = "documents"

    def retrieve(self, query: str, top_k: int | None = None, min_score: float | None = None) -> DataFrame:
        index = VectorIndex(self.collection.df(), "id", "embedding", None, self.metric)
        return retrieve_documents(index, self.embed(query), top_k or self.top_k, self.min_score if min_score is None else min_score)


@dataclass
class RagIndexer:
    """Stores documents in a ``Rag``, with the edges that its model finds in them."""

    rag: Rag
    type: str = "rag"

    def store(self, docs: DataFrame) -> Rag:
        more = self.rag.insert(index_documents(docs, dims=len(self.rag.embed(""))) if "embedding" in self.rag.docs.columns else docs)
        found = self.rag.extract(docs)
        more.edges = found if self.rag.edges is None else self.rag.edges.unionByName(found).distinct()
        return more


@dataclass
class RagRetriever:
    """Documents of a ``Rag`` for a query, by its mode."""

    rag: Rag
    mode: str = "hybrid"
    top_k: int = 5
    type: str = "rag"

    def retrieve(self, query: str, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        return self.rag.retrieve(query, self.mode, top_k or self.top_k, threshold=threshold)


def vector_bytes(v: Column) -> Column:
    """Little-endian 32-bit floats of a list of numbers."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return run(v)


def bytes_vector(b: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4").astype(float))

    return run(b)


__all__ = ["Indexer", "Rag", "RagIndexer", "RagRetriever", "Retriever", "SimpleLLM", "answer_prompt", "between_braces", "bytes_vector", "edges_of", "extracted_edges", "extraction_prompt", "index_documents", "query_entities", "query_entities_prompt", "retrieve_documents", "simple_embed", "simple_embedding", "vector_bytes"]
