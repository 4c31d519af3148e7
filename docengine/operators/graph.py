"""A graph of labelled edges (subject, predicate, object) with set semantics."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = ["subject", "predicate", "object"]


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.select(EDGE).unionByName(new.select(EDGE)).dropDuplicates(EDGE)


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(EDGE).distinct(), EDGE, "left_anti")


def _labelled(edges: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    return edges.filter(F.col("predicate").isin(list(predicates))) if predicates else edges


@dataclass(frozen=True)
class GraphQuery:
    """Steps from start nodes. Each step is a join; between steps the nodes are made distinct."""

    edges: DataFrame
    start: DataFrame | None = None
    steps: tuple[tuple[str, tuple[str, ...]], ...] = ()
    top: int = -1

    def v(self, *nodes: str) -> GraphQuery:
        spark = self.edges.sparkSession
        return replace(self, start=spark.createDataFrame([(n,) for n in nodes], "node string"))

    def of(self, nodes: DataFrame) -> GraphQuery:
        return replace(self, start=nodes.select(F.col(nodes.columns[0]).alias("node")))

    def out(self, *predicates: str) -> GraphQuery:
        return replace(self, steps=(*self.steps, ("out", predicates)))

    def in_(self, *predicates: str) -> GraphQuery:
        return replace(self, steps=(*self.steps, ("in", predicates)))

    def both(self, *predicates: str) -> GraphQuery:
        return replace(self, steps=(*self.steps, ("both", predicates)))

    def has(self, predicate: str, object_: str) -> GraphQuery:
        """Keeps the nodes reached so far that have such an edge."""
        return replace(self, steps=(*self.steps, ("has", (predicate, object_))))

    def limit(self, n: int) -> GraphQuery:
        return replace(self, top=n)

    def all(self) -> DataFrame:
        """The edges of the last step, with the node that each leads to as ``next``."""
        nodes, found = self.start, None
        for kind, predicates in self.steps if nodes is not None else ():
            if kind == "has":
                own = self.edges.filter((F.col("predicate") == predicates[0]) & (F.col("object") == predicates[1])).select(F.col("subject").alias("node"))
                nodes = nodes.join(own, "node", "left_semi")
                if found is not None:
                    found = found.join(nodes.select(F.col("node").alias("next")), "next", "left_semi").select(*EDGE, "next")
                continue
            edges = _labelled(self.edges, predicates)
            parts = []
            if kind in ("out", "both"):
                parts.append(nodes.join(edges, F.col("node") == F.col("subject")).select(*EDGE, F.col("object").alias("next")))
            if kind in ("in", "both"):
                parts.append(nodes.join(edges, F.col("node") == F.col("object")).select(*EDGE, F.col("subject").alias("next")))
            found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            nodes = found.select(F.col("next").alias("node")).distinct()
        if found is None:
            return self.edges.limit(0).select(*EDGE, F.lit(None).cast("string").alias("next"))
        return found.orderBy(*EDGE).limit(self.top) if self.top >= 0 else found

    def all_nodes(self) -> DataFrame:
        found = self.all()
        return found.select(F.col("subject").alias("node")).union(found.select("object")).distinct()

    def count(self) -> int:
        return self.all().count()

    def first(self):
        return self.all().orderBy(*EDGE).first()


def neighbors(edges: DataFrame, node: str, relation: str = "") -> DataFrame:
    """Distinct neighbours without the node: both ways, or only outwards along a relation."""
    q = GraphQuery(edges).v(node)
    found = (q.out(relation) if relation else q.both()).all()
    return found.select(F.col("next").alias("node")).filter(F.col("node") != node).distinct()


def paths(edges: DataFrame, source: str, target: str, max_depth: int = 10, *relations: str) -> DataFrame:
    """All simple paths of at most ``max_depth`` edges; undirected unless relations are given."""
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([([source],)], "path array<string>")
    own = _labelled(edges, relations).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    if not relations:
        own = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = own.distinct()
    frontier = spark.createDataFrame([([source],)], "path array<string>")
    done = None
    for _ in range(max_depth if max_depth > 0 else 10):
        step = frontier.join(own, F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        step = step.select(F.concat("path", F.array("b")).alias("path"))
        hit = step.filter(F.element_at("path", -1) == target)
        done = hit if done is None else done.unionByName(hit)
        frontier = step.filter(F.element_at("path", -1) != target)
    return done


def subgraph(edges: DataFrame, node: str, depth: int, skip: tuple[str, ...] = ("APPEARS_IN",)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an undirected walk; edges at the last depth are kept, their far nodes are not."""
    own = edges.filter(~F.col("predicate").isin(list(skip))) if skip else edges
    nodes = edges.sparkSession.createDataFrame([(node,)], "node string")
    found = None
    for level in range(max(depth, 0)):
        step = GraphQuery(own).of(nodes).both().all()
        found = step.select(EDGE).distinct() if found is None else link(found, step)
        if level < depth - 1:
            nodes = nodes.union(step.select("next")).distinct()
    return nodes, found if found is not None else own.limit(0)


@dataclass(frozen=True)
class RelationMapping:
    """A field of a collection that stands for edges from the document to others."""

    field: str
    predicate: str
    target_field: str = "id"


def bridge_edges(df: DataFrame, pk: str, mapping: RelationMapping) -> DataFrame:
    """Edges of a field that is an id, a list of ids, an object with an id, or a list of such objects."""
    kind = df.schema[mapping.field].dataType
    target: Column = F.col(mapping.field)
    if isinstance(kind, T.ArrayType):
        df, kind = df.withColumn("_t", F.explode(mapping.field)), kind.elementType
        target = F.col("_t")
    if isinstance(kind, T.StructType):
        names = [n for n in (mapping.target_field, "id", "_id") if n in kind.names]
        target = F.coalesce(*[target[n] for n in names])
    rows = df.select(F.col(pk).cast("string").alias("subject"), F.lit(mapping.predicate).alias("predicate"), target.cast("string").alias("object"))
    return rows.filter("object is not null and object <> ''").distinct()


def sync_bridge(edges: DataFrame, changed: DataFrame, pk: str, mapping: RelationMapping, replace_old: bool = False) -> DataFrame:
    """Edges after some documents changed; stale ones stay unless they are to be replaced."""
    if replace_old:
        ids = changed.select(F.col(pk).cast("string").alias("subject"), F.lit(mapping.predicate).alias("predicate"))
        edges = edges.join(ids, ["subject", "predicate"], "left_anti")
    return link(edges, bridge_edges(changed, pk, mapping))


_TEXT = re.compile(r"""^\s*V\(\s*['"]([^'"]*)['"]\s*\)\s*(?:\.\s*(Out|In)\(\s*(?:['"]([^'"]*)['"])?\s*\))?\s*$""")


def parse(edges: DataFrame, text: str) -> GraphQuery:
    """``V('x')`` with at most one ``.Out('r')`` or ``.In('r')``."""
    m = _TEXT.match(text)
    if not m:
        raise ValueError(f"not a graph query: {text}")
    q = GraphQuery(edges).v(m[1])
    relation = (m[3],) if m[3] else ()
    return q.out(*relation) if m[2] == "Out" else q.in_(*relation) if m[2] == "In" else q


def edges_of(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "subject string, predicate string, object string")
