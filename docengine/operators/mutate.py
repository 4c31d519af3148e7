"""Writes as functions from tables to tables: each gives the next snapshot, lazily."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docengine.errors import AlreadyExists, Conflict, NotFound, ValidationFailed

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Hooks:
    """Tables pass through the pre-hooks, whose errors stop the write; post-hooks see the result, and their errors do not."""

    pre_insert: list[Step] = field(default_factory=list)
    post_insert: list[Step] = field(default_factory=list)
    pre_save: list[Step] = field(default_factory=list)
    post_save: list[Step] = field(default_factory=list)
    pre_remove: list[Step] = field(default_factory=list)
    post_remove: list[Step] = field(default_factory=list)
    pre_create: list[Step] = field(default_factory=list)
    post_create: list[Step] = field(default_factory=list)

    @staticmethod
    def run(steps: list[Step], df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    @staticmethod
    def tell(steps: list[Step], df: DataFrame) -> None:
        for step in steps:
            try:
                step(df)
            except Exception:  # noqa: BLE001  a post-hook cannot undo a write
                continue


def document_id(keys: list[str]) -> Column:
    """A composite key as one string: a JSON array of its parts."""
    return F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))


def key_is(df: DataFrame, pk: list[str], doc_id: object) -> Column:
    """Whether a row's document id is this one.

    Each part of the key is compared with a literal of its own type, which the files' statistics
    can answer; the text of the whole then decides.
    """
    parts = [doc_id] if len(pk) == 1 else json.loads(str(doc_id)) if not isinstance(doc_id, list | tuple) else list(doc_id)
    if len(parts) != len(pk):
        return F.lit(False)
    whole = F.lit(True)
    for name, part in zip(pk, parts, strict=True):
        typed = F.lit(str(part)).try_cast(df.schema[name].dataType)
        whole = whole & (F.col(name) == typed) & (F.col(name).cast("string") == F.lit(str(part)))
    return whole


def revision(columns: list[str], number: Column | int = 1, rev: str = "_rev") -> Column:
    """``<n>-<hash>`` over the document without its revision."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns) if c != rev]))
    n = F.lit(number) if isinstance(number, int) else number
    return F.concat(n.cast("string"), F.lit("-"), F.sha2(body, 256))


def revision_number(rev: Column) -> Column:
    return F.coalesce(F.substring_index(rev, "-", 1).cast("int"), F.lit(0))


def with_revision(df: DataFrame, old: DataFrame | None, pk: list[str], rev: str = "_rev") -> DataFrame:
    number = F.lit(1)
    columns = [c for c in df.columns if c != rev]
    df = df.select(columns)
    if old is not None and rev in old.columns:
        df = df.join(old.select(*pk, F.col(rev).alias("_old")), pk, "left")
        number = revision_number(F.col("_old")) + 1
    return df.withColumn(rev, revision(columns, number)).select(*columns, rev)


def last_of_each(df: DataFrame, pk: list[str], order: str | None) -> DataFrame:
    """One row a key: the last by ``order``, or any one of them without it."""
    if order is None:
        return df.dropDuplicates(pk)
    rank = F.row_number().over(Window.partitionBy(*pk).orderBy(F.desc(order)))
    return df.withColumn("_k", rank).filter("_k = 1").drop("_k")


def insert(base: DataFrame, new: DataFrame, pk: list[str], hooks: Hooks | None = None) -> DataFrame:
    """All or nothing: a key that is stored or given twice, or is null, raises."""
    hooks = hooks or Hooks()
    new = hooks.run(hooks.pre_save, hooks.run(hooks.pre_create, hooks.run(hooks.pre_insert, new)))
    if new.filter(" or ".join(f"`{k}` is null" for k in pk)).limit(1).count():
        raise ValidationFailed("a primary key is missing")
    if new.groupBy(*pk).count().filter("count > 1").limit(1).count() or new.join(base, pk, "left_semi").limit(1).count():
        raise AlreadyExists("a document with this key exists")
    hooks.tell(hooks.post_save, new)
    hooks.tell(hooks.post_insert, new)
    hooks.tell(hooks.post_create, new)
    return base.unionByName(new, allowMissingColumns=True)


def upsert(base: DataFrame, new: DataFrame, pk: list[str], order: str | None = None, hooks: Hooks | None = None) -> DataFrame:
    """Whole documents replace stored ones; of a key given twice the last counts."""
    hooks = hooks or Hooks()
    new = last_of_each(hooks.run(hooks.pre_save, new), pk, order)
    new = new.drop(order) if order and order not in base.columns else new
    hooks.tell(hooks.post_save, new)
    return base.join(new.select(pk), pk, "left_anti").unionByName(new, allowMissingColumns=True)


def merge(base: DataFrame, patch: DataFrame, pk: list[str], present: Callable[[str], Column] | None = None) -> DataFrame:
    """Shallow merge: a patch's field counts where present (by default: not null); unknown keys are inserted."""
    fields = [c for c in patch.columns if c not in pk]
    present = present or (lambda c: F.col(f"_p_{c}").isNotNull())
    p = patch.select(*pk, *[F.col(c).alias(f"_p_{c}") for c in fields])
    out = base.join(p, pk, "full_outer")
    merged = {c: F.when(present(c), F.col(f"_p_{c}")).otherwise(F.col(c)) if c in base.columns else F.col(f"_p_{c}") for c in fields}
    return out.select(*pk, *[merged.get(c, F.col(c)).alias(c) for c in [*[b for b in base.columns if b not in pk], *[f for f in fields if f not in base.columns]]])


def deep_merge(old: Column, new: Column, kind: T.DataType) -> Column:
    """Objects are merged field by field; anything else, arrays too, is replaced where given."""
    if isinstance(kind, T.StructType):
        both = F.struct(*[deep_merge(old[f.name], new[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(both)
    return F.coalesce(new, old)


def deep_patch(base: DataFrame, patch: DataFrame, pk: list[str]) -> DataFrame:
    fields = [c for c in patch.columns if c not in pk]
    p = patch.select(*pk, *[F.col(c).alias(f"_p_{c}") for c in fields])
    out = base.join(p, pk, "left")
    return out.select(*[deep_merge(F.col(c), F.col(f"_p_{c}"), base.schema[c].dataType).alias(c) if c in fields else F.col(c) for c in base.columns])


def modify(base: DataFrame, pk: list[str], doc_id: object, changes: dict[str, Column]) -> DataFrame:
    """Changes of one document; its key stays."""
    hit = key_is(base, pk, doc_id)
    return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items() if c not in pk})


def atomic_update(base: DataFrame, pk: list[str], doc_id: object, seen_rev: str, changes: dict[str, Column], rev: str = "_rev") -> DataFrame:
    """As ``modify``, if the stored revision is the one that was seen; else a conflict."""
    stored = base.filter(key_is(base, pk, doc_id)).select(rev).first()
    if stored is None:
        raise NotFound(str(doc_id))
    if stored[0] != seen_rev:
        raise Conflict(f"revision is {stored[0]}")
    out = modify(base, pk, doc_id, changes)
    hit = key_is(base, pk, doc_id)
    columns = [c for c in out.columns if c != rev]
    return out.withColumn(rev, F.when(hit, revision(columns, revision_number(F.col(rev)) + 1)).otherwise(F.col(rev)))


def remove(base: DataFrame, pk: list[str], doc_id: object) -> DataFrame:
    hit = key_is(base, pk, doc_id)
    if not base.filter(hit).limit(1).count():
        raise NotFound(str(doc_id))
    return base.filter(~hit)


def bulk_remove(base: DataFrame, ids: DataFrame, pk: list[str]) -> DataFrame:
    """Unknown ids are ignored."""
    return base.join(ids.select(pk).distinct(), pk, "left_anti")


def populate(df: DataFrame, field_name: str, target: DataFrame, target_pk: str, prefix: str | None = None) -> DataFrame:
    """Each document with the one that its field refers to, null where there is none.

    The other's fields are called by the prefix, by default the field's name and an underscore.
    """
    prefix = f"{field_name}_" if prefix is None else prefix
    t = target.select(*[F.col(c).alias(f"{prefix}{c}") for c in target.columns])
    return df.join(t, df[field_name] == t[f"{prefix}{target_pk}"], "left")
