"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted. A normalised text is cut into blocks of a fixed
number of characters. The distinct blocks are sorted, and the position in that
order becomes the block's integer name: equal blocks have equal names and
different blocks have different names. Then adjacent names are paired, the
distinct pairs are sorted into new integers, and so on, until each document is a
single integer. No hash decides about equality, so the identity is free of
collisions.

A text whose pair of length and 64-bit hash occurs once in the table equals no
other text and is an identity of its own; only the others are named. This leaves
out no equal pair, since equal texts have equal lengths and hashes.

Skew: distinct blocks and pairs are pre-aggregated before they are shuffled, and
names are joined back from written tables, so that a hot block is a skewed join
that Spark splits. No group is gathered anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import discard, keyed, load, null_safe, written

NAME = "op6_exact_dedup"
BLOCK_CHARS = 4096
_UNIT = ["doc_id", "n_chars", "norm_len", "hash"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _named(distinct: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct keys with an integer each: the place in the sorted order of its partition."""
    ordered = distinct.distinct().sortWithinPartitions(*keys)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def identities(docs: DataFrame, slim: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame | None:
    """(doc_id, n_chars, norm_len, hash, level, name) for texts that may have an equal; None if none may."""
    keys = slim.groupBy("norm_len", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("norm_len", "hash")
    keys = written(keys, "dedup-keys")
    texts = docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        normalised(F.col("text")).alias("norm"),
    ).select("*", F.octet_length("norm").alias("norm_len"), F.xxhash64("norm").alias("hash"))
    texts = texts.join(keys, ["norm_len", "hash"], "left_semi")
    blocks = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    )
    rows = texts.select(*_UNIT, blocks.alias("blocks")).select(
        *_UNIT, F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("i", "block")
    )
    rows = written(rows, "dedup-blocks")
    longest = rows.agg(F.max("n_blocks")).first()[0]
    if longest is None:
        return None
    names = _named(rows.select("block"), ["block"], "dedup-names")
    named = written(rows.join(names, "block").select(*_UNIT, "n_blocks", "i", "name"), "dedup-level-0")
    discard(rows)
    rows = named
    done = []
    for level in range(math.ceil(math.log2(longest)) + 1):
        done.append(rows.filter("n_blocks = 1").select(*_UNIT, F.lit(level).alias("level"), "name").distinct())
        if level == math.ceil(math.log2(longest)):
            break
        pairs = (
            rows.filter("n_blocks > 1")
            .groupBy(*_UNIT, "n_blocks", F.shiftright("i", 1).alias("at"))
            .agg(
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        pairs = written(pairs, "dedup-pairs")
        discard(names)
        names = _named(pairs.select("left", "right"), ["left", "right"], "dedup-names")
        rows = pairs.join(names, ["left", "right"]).select(
            *_UNIT, F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), F.col("at").alias("i"), "name"
        )
        rows = written(rows, f"dedup-level-{level + 1}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return written(out, "dedup-identities")


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, key: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and, if given, the column ``key``.

    Of equal texts the row with the most code points in the original text stays,
    then the one with the smallest doc_id. Defined cases: a null text is empty;
    empty and all-white texts are equal to each other; a null doc_id sorts after
    all others and its keep_id is null if it stays; of rows repeated with the same doc_id
    and text exactly one has kept = true. An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    text = F.coalesce("text", F.lit(""))
    keys = ["key"] if key else []
    own = [F.col(key).alias("key")] if key else []
    slim = docs.select("doc_id", *own, F.length(text).alias("n_chars"), normalised(F.col("text")).alias("norm")).select(
        "doc_id",
        *keys,
        "n_chars",
        F.octet_length("norm").alias("norm_len"),
        F.xxhash64("norm").alias("hash"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    slim = written(slim.withColumn("uid", F.monotonically_increasing_id()), "dedup-slim")
    alone = F.lit(1).cast("long")
    ids = identities(docs, slim, block_chars)
    if ids is None:
        return slim.select(
            "doc_id", F.col("doc_id").alias("keep_id"), alone.alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *[F.col(k).alias(key) for k in keys]
        )
    rows = slim.join(ids, null_safe(slim, ids, _UNIT), "left").select(slim["*"], ids["level"], ids["name"])
    rows = written(rows, "dedup-rows")
    order = F.struct("n_chars", (-F.col("doc_id")).alias("a"), (-F.col("uid")).alias("b"))
    groups = (
        rows.filter("name is not null")
        .groupBy("level", "name")
        .agg(F.count("*").alias("group_size"), F.max_by(F.struct("doc_id", "uid"), order).alias("stays"))
    )
    groups = written(groups, "dedup-groups")
    return rows.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", alone).alias("group_size"),
        F.coalesce(F.col("stays.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
        *[F.col(k).alias(key) for k in keys],
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one row of each group of equal texts.

    Rows are told apart by number where doc_ids are repeated or null, so exactly one of a group
    stays. Defined cases are those of ``exact_dedup``; an empty table stays empty and columns of
    any name pass through. What is joined to the texts is the rows that go, the smaller
    side: Spark broadcasts it while its size allows and shuffles beyond that.
    """
    rows, key = keyed(docs)
    gone = written(exact_dedup(rows, key=key).filter("not kept").select(key), "dedup-gone")
    return rows.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
