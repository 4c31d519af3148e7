"""A bounded sample of labelled texts, for the classifiers that are fitted on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, per_class: int, max_chars: int) -> list[tuple[int, int, bytes]]:
    """(doc_id, label, text) of at most ``per_class`` rows of each class, in the order of a hash of doc_id.

    Texts are taken whole, in that order, while their characters add up to at
    most ``max_chars``. Rows without a label of 0 or 1 are not used, nor is a
    doc_id with two labels; rows with the same doc_id and text are one. Only lengths and hashes of
    rows are looked at before the rows are chosen, so no more than these come to the driver.
    """
    rows = labels.filter(learnable & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")
    )
    rows = rows.filter("y = other and doc_id is not null").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    some = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    texts = texts.withColumn("t", F.xxhash64("text"))
    slim = texts.groupBy("h", "doc_id", "y", "t").agg(F.max(F.length("text")).alias("n"))
    parts = [slim.filter(F.col("y") == y).orderBy("h", "doc_id", "t").limit(per_class) for y in (0, 1)]
    sizes = sorted((r.h, r.doc_id, r.t, r.n) for r in parts[0].unionByName(parts[1]).collect())
    took, total = [], 0
    for _, doc_id, t, n in sizes:
        if total + n <= max_chars:
            total += n
            took.append((doc_id, t))
    if not took:
        return []
    spark = docs.sparkSession
    ids, hashes = zip(*sorted(took), strict=True)
    # from Arrow, as rows of a list are read by Python workers of their own kind, which stay in the executors
    chosen = spark.createDataFrame(pa.table({"doc_id": list(ids), "t": list(hashes)}), f"doc_id {dict(docs.dtypes)['doc_id']}, t long")
    found = texts.join(F.broadcast(chosen), ["doc_id", "t"]).groupBy("h", "doc_id", "y", "t").agg(F.first("text").alias("text")).collect()
    return [(r.doc_id, r.y, r.text.encode()) for r in sorted(found, key=lambda r: (r.h, r.doc_id, r.text))]
