"""Databases and collections over a folder of Parquet snapshots.

A write makes a new snapshot folder and then a small pointer file whose number is one
higher than that of the snapshot it was made from. A pointer is created only if there is none of
its number, so of two writers who read the same snapshot one gets a conflict, and
readers, who take the highest whole pointer, see the old table or the new one. All
files go through Hadoop's file systems, so the folder may be in any store.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.errors import AlreadyExists, Closed, Conflict, NotFound, SchemaFailed
from docengine.operators import mutate, validate
from docengine.plans.query import Query
from docengine.streaming import changes

KEPT_VERSIONS = 10
_OPEN: dict[str, Database] = {}


@dataclass
class Schema:
    pk: list[str] = field(default_factory=lambda: ["id"])
    json: dict[str, Any] | None = None
    rev: str = "_rev"
    indexes: dict[str, list[str]] | None = None
    feed: bool = False
    version: int = 0
    migrations: dict[int, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


class Store:
    """Small files and folders through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file that is not there yet; false if it is. A line end marks it as whole."""
        path = self._path(f"{self.root}/{name}")
        if self._fs.exists(path):
            return False
        try:
            out = self._fs.create(path, False)
        except (Py4JJavaError, PySparkException) as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(f"{text}\n".encode()))
        out.close()
        return True

    def versions(self, name: str) -> list[int]:
        """The numbers of a versioned file, ascending."""
        folder, _, file = name.rpartition("/")
        where = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(where):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(where))
        return sorted(int(f.rpartition("-")[2]) for f in found if f.startswith(f"{file}-") and f.rpartition("-")[2].isdigit())

    def latest(self, name: str) -> tuple[int, str]:
        """(number, text) of the highest whole version; (0, "") if there is none."""
        for n in reversed(self.versions(name)):
            text = self.read(f"{name}-{n:010d}")
            if text.endswith("\n"):
                return n, text[:-1]
        return 0, ""

    def advance(self, name: str, seen: int, text: str) -> None:
        """Put a version behind the one that was seen; a conflict if somebody else has."""
        if not self.create(f"{name}-{seen + 1:010d}", text):
            raise Conflict(f"{name} has moved on from version {seen}")
        for n in self.versions(name):
            if n <= seen + 1 - KEPT_VERSIONS:
                self.delete(f"{name}-{n:010d}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(f"{self.root}/{name}".rstrip("/")), True)

    def folders(self, below: str = "") -> list[str]:
        where = self._path(f"{self.root}/{below}".rstrip("/"))
        if not self._fs.exists(where):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where) if s.isDirectory())


def index_diff(stored: dict[str, list[str]], wanted: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """(names to drop, names to build) for a schema whose indexes have changed; an index with other fields is both."""
    drop = sorted(n for n, fields in stored.items() if wanted.get(n) != fields)
    return drop, sorted(n for n, fields in wanted.items() if stored.get(n) != fields)


class Collection:
    def __init__(self, db: Database, name: str, schema: Schema):
        self.db, self.name, self.schema, self.hooks = db, name, schema, mutate.Hooks()
        self._seen = 0
        number, text = db.store.latest(f"{name}/schema")
        stored = int(text) if text else None
        if stored is not None and stored > schema.version:
            raise SchemaFailed(f"{name} is stored in version {stored}")
        if stored is not None and stored < schema.version and self._stored():
            self._save(validate.migrate(self.all(), schema.migrations, stored, schema.version))
        if stored != schema.version:
            db.store.advance(f"{name}/schema", number, str(schema.version))
        self._set_indexes(schema.indexes)

    def _set_indexes(self, wanted: dict[str, list[str]] | None) -> None:
        """Bring the stored indexes to those of the schema; without any in the schema the stored ones hold."""
        number, text = self.db.store.latest(f"{self.name}/indexes")
        stored = json.loads(text) if text else {}
        self.schema.indexes = stored if wanted is None else dict(wanted)
        drop, build = index_diff(stored, self.schema.indexes)
        if drop or build:
            self.db.store.advance(f"{self.name}/indexes", number, json.dumps(self.schema.indexes, sort_keys=True))
        if build and self._stored():
            self._save(self.df())

    @property
    def version(self) -> int:
        """The number of the stored snapshot."""
        return self.db.store.latest(f"{self.name}/current")[0]

    def _sorted(self, df: DataFrame) -> DataFrame:
        """In the order of the first index, so that statistics of the files prune what a condition on it reads."""
        fields = next((f for f in (self.schema.indexes or {}).values() if set(f) <= set(df.columns)), None)
        return df.repartitionByRange(*fields).sortWithinPartitions(*fields) if fields else df

    def _save(self, df: DataFrame, touched: DataFrame | None = None) -> None:
        """Store a snapshot made from the one that ``df`` was read from; ``touched`` has the keys that may differ."""
        self.db.check()
        seen, old = self._seen, self._at(self._seen)
        part = f"{self.name}/snapshot-{uuid.uuid4().hex}"
        self._sorted(df).write.parquet(f"{self.db.store.root}/{part}")
        try:
            self.db.store.advance(f"{self.name}/current", seen, part)
        except Conflict:
            self.db.store.delete(part)
            raise
        self._seen = seen + 1
        if self.schema.feed:
            new = self._at(self._seen)
            old = old if old is not None else new.limit(0)
            if touched is not None:
                keys = touched.select(*self.schema.pk).distinct()
                old, new = (x.join(keys, self.schema.pk, "left_semi") for x in (old, new))
            changes.append(changes.diff(old, new, self.schema.pk, self.name, self._seen), self._feed)
        live = {self.db.store.read(f"{self.name}/current-{n:010d}").strip() for n in self.db.store.versions(f"{self.name}/current")}
        for folder in self.db.store.folders(self.name):
            if folder.startswith("snapshot-") and live and f"{self.name}/{folder}" not in live and self._is_old(folder):
                self.db.store.delete(f"{self.name}/{folder}")

    def _is_old(self, folder: str) -> bool:
        """Whether a snapshot without a pointer was dropped, rather than being written by somebody now."""
        path = self.db.store._path(f"{self.db.store.root}/{self.name}/{folder}")
        return self.db.store._fs.getFileStatus(path).getModificationTime() < (time.time() - 3600) * 1000

    def _at(self, number: int) -> DataFrame | None:
        if not number:
            return None
        part = self.db.store.read(f"{self.name}/current-{number:010d}").strip()
        return self.db.spark.read.parquet(f"{self.db.store.root}/{part}")

    @property
    def _feed(self) -> str:
        return f"{self.db.store.root}/{self.name}/changes"

    def changes(self) -> DataFrame:
        """The log of changes, if the schema asks for one."""
        if not self.db.store.exists(f"{self.name}/changes"):
            return self.db.spark.createDataFrame([], changes.SCHEMA)
        return changes.log(self.db.spark, self._feed)

    def change_stream(self) -> DataFrame:
        return changes.stream(self.db.spark, self._feed)

    def _stored(self) -> bool:
        self.db.check()
        self._seen = self.version
        return self._seen > 0

    def all(self) -> DataFrame:
        """All documents in the order of their keys."""
        return self.df().orderBy(*self.schema.pk)

    def df(self) -> DataFrame:
        self.db.check()
        if not self._stored():
            raise NotFound(f"{self.name} has no documents yet")
        return self._at(self._seen)

    def find(self, selector: dict | None = None) -> Query:
        return Query(self.df(), selector or {}, self.schema.pk[0])

    def lookup(self, doc_id: object) -> DataFrame:
        """The document of an id as a table, found by the files' statistics of its key."""
        df = self.df()
        return df.filter(mutate.key_is(df, self.schema.pk, doc_id))

    def find_by_id(self, doc_id: object):
        row = self.lookup(doc_id).limit(1).first()
        if row is None:
            raise NotFound(str(doc_id))
        return row

    def document(self, doc_id: object) -> Document:
        return Document(self, doc_id)

    def exists(self, doc_id: object) -> bool:
        return self._stored() and self.lookup(doc_id).limit(1).count() > 0

    def count(self) -> int:
        return self.df().count() if self._stored() else 0

    def _checked(self, rows: DataFrame, defaults: bool) -> DataFrame:
        if self.schema.json:
            rows = validate.apply_defaults(rows, self.schema.json) if defaults else rows
            if rows.filter(~validate.is_valid(rows, self.schema.json)).limit(1).count():
                from docengine.errors import ValidationFailed

                bad = validate.errors(rows, self.schema.json, self.schema.pk).first()
                raise ValidationFailed(f"{bad.path} {bad.message}" if bad else "invalid")
        return rows

    def insert(self, rows: DataFrame) -> None:
        rows = self._checked(rows, defaults=True)
        rows = mutate.with_revision(rows, None, self.schema.pk, self.schema.rev)
        base = self.df() if self._stored() else rows.limit(0)
        self._save(mutate.insert(base, rows, self.schema.pk, self.hooks), rows)

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        rows = mutate.last_of_each(self._checked(rows, defaults=False), self.schema.pk, order)
        old = self.df() if self._stored() else None
        if self.schema.json:
            rows = validate.apply_defaults(rows, self.schema.json)
            if old is not None and validate.final_violations(old, rows, self.schema.json, self.schema.pk).limit(1).count():
                raise SchemaFailed("a final field would change")
        rows = mutate.with_revision(rows.drop(order) if order else rows, old, self.schema.pk, self.schema.rev)
        self._save(mutate.upsert(old if old is not None else rows.limit(0), rows, self.schema.pk, hooks=self.hooks), rows)

    import_json = upsert

    def incremental_upsert(self, patch: DataFrame) -> None:
        self._save(mutate.merge(self.df(), patch, self.schema.pk), patch)

    def incremental_modify(self, doc_id: object, new: dict[str, Column]) -> None:
        df = self.df()
        self._save(mutate.modify(df, self.schema.pk, doc_id, new), df.filter(mutate.key_is(df, self.schema.pk, doc_id)))

    def atomic_update(self, doc_id: object, seen_rev: str, new: dict[str, Column]) -> None:
        """Changes to the revision that was seen; a conflict if that, or the table, has moved on meanwhile."""
        df = self.df()
        out = mutate.atomic_update(df, self.schema.pk, doc_id, seen_rev, new, self.schema.rev)
        self._save(out, df.filter(mutate.key_is(df, self.schema.pk, doc_id)))

    def atomic_patch(self, patch: DataFrame) -> None:
        self._save(mutate.deep_patch(self.df(), patch, self.schema.pk), patch)

    def remove(self, doc_id: object) -> None:
        df = self.df()
        self._save(mutate.remove(self.hooks.run(self.hooks.pre_remove, df), self.schema.pk, doc_id), df.filter(mutate.key_is(df, self.schema.pk, doc_id)))
        self.hooks.tell(self.hooks.post_remove, self.df())

    def bulk_remove(self, ids: DataFrame) -> None:
        self._save(mutate.bulk_remove(self.df(), ids, self.schema.pk), ids)

    def apply(self, feed: DataFrame) -> None:
        """Changes of another table's log, the last of each document: its upserts, then its deletions."""
        last = feed.groupBy("id").agg(F.max_by(F.struct("op", "doc"), "seq").alias("x")).select("id", "x.*")
        kept = last.filter("op <> 'delete'").select("doc")
        if kept.limit(1).count():
            part = f"{self.name}/incoming-{uuid.uuid4().hex}"
            kept.write.text(f"{self.db.store.root}/{part}")
            reader = self.db.spark.read.schema(self.df().schema) if self._stored() else self.db.spark.read
            self.upsert(reader.json(f"{self.db.store.root}/{part}").drop(self.schema.rev))
            self.db.store.delete(part)
        gone = last.filter("op = 'delete'").select(F.col("id").alias("_gone"))
        if self._stored() and gone.limit(1).count():
            df = self.df()
            rows = df.withColumn("_id", mutate.document_id(self.schema.pk))
            self._save(rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").drop("_id"))

    def exists_any(self) -> bool:
        return self._stored()

    def replace(self, rows: DataFrame) -> None:
        """All documents at once, made from the snapshot that was read last."""
        self._save(rows)

    def export_json(self, path: str | None = None) -> DataFrame:
        rows = self.all().select(F.to_json(F.struct("*")).alias("value"))
        if path:
            rows.write.mode("overwrite").text(path)
        return rows

    def create_index(self, name: str, fields: list[str]) -> None:
        """Kept with the collection; files are sorted by the first index now and at each later write."""
        if name in self.schema.indexes or fields in self.schema.indexes.values():
            raise AlreadyExists(f"index {name}")
        self._set_indexes(self.schema.indexes | {name: list(fields)})

    def drop_index(self, name: str) -> None:
        if name not in self.schema.indexes:
            raise NotFound(f"index {name}")
        self._set_indexes({n: f for n, f in self.schema.indexes.items() if n != name})

    def list_indexes(self) -> dict[str, list[str]]:
        return dict(self.schema.indexes)

    def put_attachments(self, doc_id: str, path: str) -> None:
        """Files with their digests, from a path or glob, for one document."""
        self.attach(attachments_of(self.db.spark, doc_id, path))

    def _keep_attachments(self, rows: DataFrame, seen: int) -> None:
        part = f"{self.name}/attachments-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.db.store.root}/{part}")
        self.db.store.advance(f"{self.name}/files", seen, part)

    def attach(self, rows: DataFrame) -> None:
        seen, _ = self.db.store.latest(f"{self.name}/files")
        old = self.attachments() if seen else rows.limit(0)
        self._keep_attachments(mutate.upsert(old, rows, ["doc_id", "att_id"]), seen)

    def has_attachments(self) -> bool:
        return self.db.store.latest(f"{self.name}/files")[0] > 0

    def attachments(self, doc_id: str | None = None, att_id: str | None = None) -> DataFrame:
        df = self.db.spark.read.parquet(f"{self.db.store.root}/{self.db.store.latest(f'{self.name}/files')[1]}")
        df = df.filter(F.col("doc_id") == doc_id) if doc_id is not None else df
        return df.filter(F.col("att_id") == att_id) if att_id is not None else df

    def remove_attachment(self, doc_id: str, att_id: str) -> None:
        seen, _ = self.db.store.latest(f"{self.name}/files")
        rows = self.attachments().filter(~((F.col("doc_id") == doc_id) & (F.col("att_id") == att_id)))
        self._keep_attachments(rows, seen)

    def dump(self, path: str) -> None:
        """Documents, and attachments as base64, as JSON."""
        self.df().write.mode("overwrite").json(f"{path}/docs")
        if self.has_attachments():
            self.attachments().withColumn("content", F.base64("content")).write.mode("overwrite").json(f"{path}/attachments")

    def import_dump(self, path: str) -> None:
        self.upsert(self.db.spark.read.json(f"{path}/docs").drop(self.schema.rev))
        folder = Store(self.db.spark, path)
        if folder.exists("attachments"):
            rows = self.db.spark.read.schema("doc_id string, att_id string, content string").json(f"{path}/attachments")
            body = rows.withColumn("content", F.unbase64("content"))
            self.attach(digested(body.select("doc_id", "att_id", "content")))


class Document:
    """A handle on one document: each call reads or writes the stored one."""

    def __init__(self, collection: Collection, doc_id: object):
        self.collection, self.id = collection, doc_id

    @property
    def data(self) -> dict:
        return self.collection.find_by_id(self.id).asDict(recursive=True)

    @property
    def revision(self) -> str:
        return self.data[self.collection.schema.rev]

    def get(self, path: str) -> object:
        """A field by its dotted path; None where there is none."""
        value: object = self.data
        for step in path.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        return value

    def deleted(self) -> bool:
        return not self.collection.exists(self.id)

    def update(self, new: dict[str, object]) -> None:
        """Set fields and raise the revision, if nobody else has since it was read."""
        columns = {k: v if isinstance(v, Column) else F.lit(v) for k, v in new.items()}
        self.collection.atomic_update(self.id, self.revision, columns)

    def set(self, name: str, value: object) -> None:
        self.update({name: value})

    def remove(self) -> None:
        self.collection.remove(self.id)

    def changes(self) -> DataFrame:
        return changes.of_document(self.collection.changes(), str(self.id))

    def put_attachment(self, path: str) -> None:
        self.collection.put_attachments(str(self.id), path)

    def attachments(self, att_id: str | None = None) -> DataFrame:
        return self.collection.attachments(str(self.id), att_id)

    def remove_attachment(self, att_id: str) -> None:
        self.collection.remove_attachment(str(self.id), att_id)


def digested(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "att_id", "content", F.length("content").alias("size"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def attachments_of(spark: SparkSession, doc_id: str, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return digested(files.select(F.lit(doc_id).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("att_id"), "content"))


class Database:
    """A named folder of collections; a name is open once unless that is allowed."""

    def __init__(self, spark: SparkSession, name: str, path: str, ignore_duplicate: bool = False, close_duplicate: bool = False, multi_instance: bool = False):
        if name in _OPEN and not (ignore_duplicate or multi_instance):
            if not close_duplicate:
                raise AlreadyExists(f"database {name} is open")
            _OPEN[name].close()
        self.spark, self.name, self.store, self.open = spark, name, Store(spark, f"{path.rstrip('/')}/{name}"), True
        self.instance = uuid.uuid4().hex
        self._collections: dict[str, Collection] = {}
        _OPEN.setdefault(name, self)

    def check(self) -> None:
        if not self.open:
            raise Closed(self.name)

    def collection(self, name: str, schema: Schema | None = None) -> Collection:
        self.check()
        if name not in self._collections or schema is not None and schema.version != self._collections[name].schema.version:
            self._collections[name] = Collection(self, name, schema or Schema())
        return self._collections[name]

    def collections(self) -> list[str]:
        return self.store.folders()

    def export_json(self) -> dict[str, DataFrame]:
        return {n: self.collection(n).export_json() for n in self.collections()}

    def import_json(self, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            self.collection(name).upsert(rows)

    def backup(self, path: str) -> None:
        """Documents, attachments, indexes and schema versions of all collections."""
        target = Store(self.spark, path)
        for name in self.collections():
            own = self.collection(name)
            if own._stored():
                own.df().write.mode("overwrite").parquet(f"{target.root}/{name}")
            if own.has_attachments():
                own.attachments().write.mode("overwrite").parquet(f"{target.root}/{name}.attachments")
            target.delete(f"{name}.collection")
            target.create(f"{name}.collection", json.dumps({"version": own.schema.version, "pk": own.schema.pk, "indexes": own.list_indexes()}))

    def restore(self, path: str) -> None:
        """Collections of a backup that this database does not have."""
        source = Store(self.spark, path)
        for name in (f for f in source.folders() if not f.endswith(".attachments")):
            if name in self.collections():
                raise AlreadyExists(f"collection {name}")
            told = json.loads(source.read(f"{name}.collection"))
            own = self.collection(name, Schema(pk=told["pk"], version=told["version"], indexes=told["indexes"]))
            own._save(self.spark.read.parquet(f"{source.root}/{name}"))
            if source.exists(f"{name}.attachments"):
                own.attach(self.spark.read.parquet(f"{source.root}/{name}.attachments"))

    def changes(self) -> DataFrame:
        """The logs of all collections that keep one."""
        out = self.spark.createDataFrame([], changes.SCHEMA)
        for name in self.collections():
            out = out.unionByName(self.collection(name).changes())
        return out

    def wait_for_leadership(self, timeout: float = 30.0, lease: float = 60.0) -> bool:
        """Become the one leader among the sessions that share the folder; a leader's lease that has run out may be taken."""
        until = time.time() + timeout
        while True:
            number, text = self.store.latest("leader")
            holder, since = (text.split(" ") if text else ("", "0"))
            if holder in ("", self.instance) or time.time() - float(since) > lease:
                try:
                    self.store.advance("leader", number, f"{self.instance} {time.time()}")
                    return True
                except Conflict:
                    pass
            if time.time() >= until:
                return False
            time.sleep(0.2)

    def resign(self) -> None:
        number, text = self.store.latest("leader")
        if text.startswith(f"{self.instance} "):
            self.store.advance("leader", number, " 0")

    def close(self) -> None:
        self.open = False
        if _OPEN.get(self.name) is self:
            del _OPEN[self.name]

    def destroy(self) -> None:
        self.close()
        self.store.delete()
