"""Session helpers shared by every module: shared folders, written tables, shipped code."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from docengine.errors import IoFailed

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _BATCH_DEFAULT, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"
_PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and all runs in
    one process, as in local tests, a temporary folder is made and set for this session; on
    a cluster that is an error, as executors would each write to their own disk.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise IoFailed("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docengine-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs a re-read, never a
    recomputation of what came before. Spark drops the write's own shuffle files when it is
    done, rather than at some later garbage collection. The schema is passed on, which saves the
    inference job and keeps an empty result readable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docengine-{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and that is not needed any more."""
    jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
    for file in table.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("docengine-"):
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def ship_code(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per session.

    Rows go to them in batches that stay small where a row is a long text, unless the session has
    a size of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, _BATCH_ROWS)
    if getattr(context, "_docengine_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="docengine-code-"), "docengine.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, f"docengine/{source.relative_to(_PACKAGE)}")
    context.addPyFile(target)
    context._docengine_shipped = True
