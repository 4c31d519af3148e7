"""Replication with a remote table over HTTP, in the manner of PostgREST.

Rows are read with ``GET <url>/rest/v1/<table>``, since a stamp with ``?<stamp>=gte.<value>``
and one by ``?<key>=eq.<id>``; inserts go by POST, updates by PATCH and deletions by DELETE. The source and
the sink are Spark data sources, so pages are read and changes are sent by the executors.
Pulled rows go into a collection by a conflict rule. Local changes are taken from the collection's log;
those that fail wait in a queue, a table beside the collection, until their time has come.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docengine.session import ship_code
from docengine.sources.catalog import Collection
from docengine.streaming import changes

TIMEOUT, RETRIES, INTERVAL, PAGE_ROWS = 30, 10, 5, 1000
FAILED = "id string, op string, doc string, error string, created timestamp, retries int"


def call(method: str, url: str, key: str = "", body: str | None = None, timeout: int = TIMEOUT) -> tuple[int, str]:
    """(status, body) of one request; an unreachable server has status 0."""
    head = {"apikey": key, "Authorization": f"Bearer {key}", "Content-Type": "application/json", "Prefer": "resolution=merge-duplicates"}
    request = urllib.request.Request(url, body.encode() if body is not None else None, head, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except OSError as e:
        return 0, str(e)


class _Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        super().__init__(offset)
        self.offset, self.limit = offset, limit


class _Reader(DataSourceReader):
    """Pages of a fixed number of rows, as many as the option ``rows`` asks for; the last goes on to the end."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        size = int(self.options.get("page", PAGE_ROWS))
        pages = max(1, -(-int(self.options.get("rows", size)) // size))
        return [_Page(k * size, size if k + 1 < pages else 0) for k in range(pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        size = int(self.options.get("page", PAGE_ROWS))
        at = partition.offset
        while True:
            query = [x for x in (self.options.get("filter", ""), f"order={self.options['key']}", f"limit={partition.limit or size}", f"offset={at}") if x]
            status, body = call("GET", f"{self.options['url']}/rest/v1/{self.options['table']}?{'&'.join(query)}", self.options.get("apikey", ""))
            if status != 200:
                raise RuntimeError(f"pull failed: {status} {body[:200]}")
            rows = json.loads(body)
            for row in rows:
                yield tuple(row.get(n) for n in self.names)
            at += len(rows)
            if partition.limit or len(rows) < size:
                return


class _Writer(DataSourceWriter):
    """Sends change rows (id, op, doc); a change that the remote refuses fails the write."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        failed = [r for r in (_send(self.options, row.id, row.op, row.doc) for row in rows) if r]
        if failed:
            raise RuntimeError(f"push failed for {len(failed)} changes, the first: {failed[0]}")
        return WriterCommitMessage()


def _send(options: dict, doc_id: str, op: str, doc: str | None) -> str | None:
    """None if the remote took the change, else what it said."""
    where = f"{options['url']}/rest/v1/{options['table']}"
    one = f"{where}?{options['key']}=eq.{urllib.parse.quote(str(doc_id))}"
    method, url = {"insert": ("POST", where), "update": ("PATCH", one), "delete": ("DELETE", one)}[op]
    status, body = call(method, url, options.get("apikey", ""), doc if op != "delete" else None)
    return None if 200 <= status < 300 else f"{status} {body[:200]}"


class RestTable(DataSource):
    """``spark.read.format("rest_table").schema(…).options(url=…, table=…, key=…)``, and the same to write changes."""

    @classmethod
    def name(cls) -> str:
        return "rest_table"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


@dataclass
class Remote:
    """Where the other table is."""

    url: str
    table: str
    key: str = "id"
    stamp: str = "updated_at"
    apikey: str = ""

    def options(self) -> dict[str, str]:
        return {"url": self.url, "table": self.table, "key": self.key, "apikey": self.apikey}


def realtime_changes(messages: DataFrame, pk: str = "id") -> DataFrame:
    """(id, op, doc, seq) of change messages (value, seq): JSON with eventType, new and old; others are left out."""
    body = F.col("value")
    payload = F.when(F.get_json_object(body, "$.event") == "postgres_changes", F.get_json_object(body, "$.payload")).otherwise(body)
    kind = F.get_json_object("p", "$.eventType")
    op = F.when(kind == "INSERT", "insert").when(kind == "UPDATE", "update").when(kind == "DELETE", "delete")
    doc_id = F.when(op == "delete", F.get_json_object("p", f"$.old.{pk}")).otherwise(F.get_json_object("p", f"$.new.{pk}"))
    rows = messages.select(payload.alias("p"), "seq").select(doc_id.alias("id"), op.alias("op"), F.get_json_object("p", "$.new").alias("doc"), "seq")
    return rows.filter("id is not null and op is not null")


@dataclass
class Replication:
    """Keeps a collection and a remote table alike; nothing runs but when it is called or started."""

    collection: Collection
    remote: Remote
    resolve: Callable[[str], Column] | None = None
    interval: int = INTERVAL
    most: int = RETRIES
    state: str = "idle"
    since: object | None = None
    pushed: int = 0
    errors: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        spark = self.collection.db.spark
        ship_code(spark)
        spark.dataSource.register(RestTable)

    def _read(self, condition: str = "") -> DataFrame:
        spark = self.collection.db.spark
        schema = StructType([f for f in self.collection.df().schema if f.name != self.collection.schema.rev])
        return spark.read.format("rest_table").schema(schema).options(**self.remote.options(), filter=condition).load()

    def _take(self, rows: DataFrame) -> int:
        """Remote rows into the collection; the rule decides where both have a document."""
        own, pk = self.collection, self.collection.schema.pk
        local = own.df().drop(own.schema.rev).join(rows.select(*pk), pk, "left_semi")
        own.upsert(changes.conflicts(local, rows, pk, self.resolve).select(*local.columns))
        return rows.count()

    def pull_once(self) -> int:
        """Rows since the last pull's greatest stamp; all of them the first time."""
        self.state = "pulling"
        try:
            stamp = self.remote.stamp
            rows = self._read(f"{stamp}=gte.{urllib.parse.quote(str(self.since))}" if self.since is not None else "")
            top = rows.agg(F.max(stamp)).first()[0]
            if top is None:
                return 0
            n = self._take(rows)
            self.since = top
            return n
        finally:
            self.state = "idle"

    def pull_doc(self, doc_id: object) -> int:
        return self._take(self._read(f"{self.remote.key}=eq.{urllib.parse.quote(str(doc_id))}"))

    def queue(self) -> DataFrame:
        """Failed changes, the last failure of each document."""
        store, spark = self.collection.db.store, self.collection.db.spark
        number, part = store.latest(f"{self.collection.name}/queue")
        return spark.read.schema(FAILED).parquet(f"{store.root}/{part}") if number else spark.createDataFrame([], FAILED)

    def _keep_queue(self, rows: DataFrame) -> None:
        store = self.collection.db.store
        number, _ = store.latest(f"{self.collection.name}/queue")
        part = f"{self.collection.name}/queue-{uuid.uuid4().hex}"
        rows.write.parquet(f"{store.root}/{part}")
        store.advance(f"{self.collection.name}/queue", number, part)

    def _sent(self, rows: DataFrame) -> DataFrame:
        """Rows (id, op, doc, created, retries) with what went wrong, null if nothing did; sent by the executors, once: the result is written."""
        options = self.remote.options()

        @F.udf(returnType="string")
        def send(doc_id, op, doc):
            return _send(options, doc_id, op, doc)

        store, spark = self.collection.db.store, self.collection.db.spark
        part = f"{store.root}/{self.collection.name}/sent-{uuid.uuid4().hex}"
        rows.withColumn("error", send.asNondeterministic()("id", "op", "doc")).write.parquet(part)
        return spark.read.parquet(part)

    def push_once(self) -> int:
        """The last change of each document since the last push, and the retries that are due; what fails is queued."""
        self.state = "pushing"
        try:
            feed = self.collection.changes().filter(F.col("seq") > self.pushed)
            top = feed.agg(F.max("seq")).first()[0]
            last = feed.groupBy("id").agg(F.min_by("op", "seq").alias("began"), F.max_by(F.struct("op", "doc"), "seq").alias("x"))
            op = F.when((F.col("began") == "insert") & (F.col("x.op") == "update"), "insert").otherwise(F.col("x.op"))
            new = last.select("id", op.alias("op"), F.col("x.doc").alias("doc"), F.current_timestamp().alias("created"), F.lit(0).alias("retries"))
            queue = self.queue().filter(F.col("retries") < self.most)
            due = changes.due_retries(queue, F.current_timestamp(), self.interval, self.most)
            waiting = queue.join(due.select("id"), "id", "left_anti").join(new.select("id"), "id", "left_anti")
            again = due.join(new.select("id"), "id", "left_anti").withColumn("retries", F.col("retries") + 1).drop("error")
            done = self._sent(new.unionByName(again))
            failed = done.filter("error is not null")
            self._keep_queue(waiting.unionByName(failed.select(*waiting.columns)))
            self.pushed = top if top is not None else self.pushed
            self.errors += [r[0] for r in failed.select("error").limit(10).collect()]
            return done.filter("error is null").count()
        finally:
            self.state = "idle"

    def apply_realtime(self, messages: DataFrame) -> None:
        """A batch of change messages (value, seq) into the collection; for ``foreachBatch``."""
        self.collection.apply(realtime_changes(messages, self.remote.key))

    def start_realtime(self, messages: DataFrame, checkpoint: str, once: bool = True):
        """Follow a stream of messages (value, seq), from whatever source carries them."""
        writer = messages.writeStream.foreachBatch(lambda batch, _: self.apply_realtime(batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{self.interval} seconds")).start()

    def run(self, rounds: int, pause: float = 10.0) -> None:
        """Pull and push by turns; an error is noted and the next round goes on."""
        for k in range(rounds):
            if self.state == "stopped":
                return
            for step in (self.pull_once, self.push_once):
                try:
                    step()
                except Exception as e:  # noqa: BLE001  a round that fails must not end the others
                    self.errors.append(str(e)[:200])
            if k + 1 < rounds:
                time.sleep(pause)

    def stop(self) -> None:
        self.state = "stopped"

    def synced(self) -> bool:
        """Whether no local change waits to be pushed."""
        return self.collection.changes().filter(F.col("seq") > self.pushed).isEmpty() and self.queue().isEmpty()

    def resync(self, doc_id: object) -> int:
        """Take the remote's state of one document: its row, or its absence."""
        rows = self._read(f"{self.remote.key}=eq.{urllib.parse.quote(str(doc_id))}")
        if rows.isEmpty():
            if self.collection.exists(doc_id):
                self.collection.remove(doc_id)
            return 0
        return self._take(rows)


__all__ = ["Remote", "Replication", "RestTable", "call", "realtime_changes"]
