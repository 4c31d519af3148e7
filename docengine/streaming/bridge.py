"""A graph that follows a collection: edges of a field, brought up to date from the log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docengine.operators.graph import RelationMapping, edges_of, sync_bridge
from docengine.sources.catalog import Collection
from docengine.streaming import changes


def apply_batch(batch: DataFrame, source: Collection, edges: Collection, mapping: RelationMapping, replace_old: bool = False) -> None:
    """The last change of each document in a batch: edges of what is there now, none of what went if old ones are replaced."""
    pk = source.schema.pk[0]
    last = batch.groupBy("id").agg(F.max_by(F.struct("op", "doc"), "seq").alias("x")).select("id", "x.*")
    if last.isEmpty():
        return
    docs = last.filter("op <> 'delete'").select(F.from_json("doc", source.df().schema).alias("d")).select("d.*")
    own = edges.df() if edges.exists_any() else edges_of(batch.sparkSession, [])
    if replace_old:
        gone = last.select(F.col("id").alias("subject"), F.lit(mapping.predicate).alias("predicate"))
        own = own.join(gone, ["subject", "predicate"], "left_anti")
    edges.replace(sync_bridge(own.select("subject", "predicate", "object"), docs, pk, mapping, replace_old))


def auto_sync(source: Collection, edges: Collection, mapping: RelationMapping, checkpoint: str, replace_old: bool = False, once: bool = True) -> StreamingQuery:
    """Follow the collection's log; ``edges`` has the key (subject, predicate, object)."""
    run = lambda batch, _: apply_batch(batch, source, edges, mapping, replace_old)
    return changes.follow(source.db.spark, source._feed, checkpoint, run, once)
