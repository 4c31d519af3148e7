"""Change feeds: a log of changes as a table, read as a batch or a stream.

A change has collection, id, op (insert, update, delete), doc and old as JSON, rev,
seq and ts. The log only grows and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from docengine.functions.mango import compile_selector
from docengine.operators import mutate

SCHEMA = "collection string, id string, op string, doc string, old string, rev string, seq long, ts timestamp"


def diff(old: DataFrame, new: DataFrame, pk: list[str], collection: str, seq: int) -> DataFrame:
    """The changes between two snapshots."""
    a = old.select(mutate.document_id(pk).alias("id"), F.to_json(F.struct(*sorted(old.columns))).alias("old"))
    b = new.select(mutate.document_id(pk).alias("id"), F.to_json(F.struct(*sorted(new.columns))).alias("doc"))
    both = a.join(b, "id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("doc")))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("doc").isNull(), "delete").otherwise("update")
    rev = F.get_json_object(F.coalesce("doc", "old"), "$._rev")
    return both.select(
        F.lit(collection).alias("collection"), "id", op.alias("op"), "doc", "old", rev.alias("rev"), F.lit(seq).cast("long").alias("seq"), F.current_timestamp().alias("ts")
    )


def append(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def of_document(changes: DataFrame, doc_id: str) -> DataFrame:
    return changes.filter(F.col("id") == doc_id)


def field_changes(changes: DataFrame, name: str, doc_id: str | None = None) -> DataFrame:
    """(id, seq, field, old, new) of the changes in which a field differs."""
    rows = of_document(changes, doc_id) if doc_id is not None else changes
    a, b = F.get_json_object("old", f"$.{name}"), F.get_json_object("doc", f"$.{name}")
    return rows.filter(~a.eqNullSafe(b)).select("id", "seq", F.lit(name).alias("field"), a.alias("old"), b.alias("new"))


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each document that is not deleted: pre-aggregated, not sorted."""
    last = changes.groupBy("collection", "id").agg(F.max_by(F.struct("op", "doc", "rev"), "seq").alias("x"), F.max("seq").alias("seq"))
    return last.select("collection", "id", "x.*", "seq").filter("op <> 'delete'")


def follow(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Give each new batch of changes to ``each``; the position is kept in the checkpoint."""
    writer = stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def observe(spark: SparkSession, path: str, checkpoint: str, current: Callable[[], DataFrame], selector: dict, emit: Callable[[DataFrame], None], once: bool = True) -> StreamingQuery:
    """Run a selector again after each batch of changes and emit its result if that has changed.

    Changed means other documents or other contents: both are in a digest of the
    result that is one row, whatever the result's size.
    """
    seen: list = [None]

    def run(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        df = current()
        out = df.filter(compile_selector(df, selector))
        h = F.xxhash64(*out.columns)
        mark = tuple(out.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 8))).first())
        if mark != seen[0]:
            seen[0] = mark
            emit(out)

    return follow(spark, path, checkpoint, run, once)


def conflicts(local: DataFrame, remote: DataFrame, pk: list[str], resolve: Callable[[str], Column] | None = None) -> DataFrame:
    """Local and remote put together; where both have a key the remote wins, or what ``resolve`` says for each field.

    ``resolve`` gets a field's name and gives a Column over ``l.<field>`` and ``r.<field>``.
    """
    both = local.alias("l").join(remote.alias("r"), [F.col(f"l.{k}") == F.col(f"r.{k}") for k in pk], "full_outer")
    there = F.col(f"r.{pk[0]}").isNotNull()
    here = F.col(f"l.{pk[0]}").isNotNull()
    out = []
    for c in local.columns:
        if c in pk:
            out.append(F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c))
            continue
        chosen = resolve(c) if resolve else F.col(f"r.{c}")
        out.append(F.when(here & there, chosen).when(there, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")).alias(c))
    return both.select(*out)


def pull(remote: DataFrame, since: object | None, stamp: str = "updated_at") -> tuple[DataFrame, object]:
    """Rows not before ``since``, and the next position: the greatest stamp that the remote has."""
    rows = remote.filter(F.col(stamp) >= F.lit(since)) if since is not None else remote
    top = rows.agg(F.max(stamp)).first()[0]
    return rows, top if top is not None else since


def due_retries(queue: DataFrame, now: Column, interval: int = 5, most: int = 10) -> DataFrame:
    """Failed pushes whose time has come; those tried ``most`` times are dropped."""
    due = F.col("created").cast("timestamp").cast("double") + (F.col("retries") + 1) * interval
    return queue.filter((F.col("retries") < most) & (due <= now.cast("timestamp").cast("double")))


def in_order(changes: DataFrame) -> DataFrame:
    """Changes with their place among those of their document."""
    return changes.withColumn("place", F.row_number().over(Window.partitionBy("collection", "id").orderBy("seq")))
