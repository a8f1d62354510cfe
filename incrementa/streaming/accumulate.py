"""Histograms of slices as they arrive: counts add up, so a stream of them keeps running totals (AGG-5).

:func:`running_counts` leaves the totals to the query's own state. :func:`accumulate` keeps them as a table that other jobs
read, each slice counted exactly once: totals and the log of the slices in them are one version, written aside and moved
into place in one step. A batch that is replayed after a failure, or a slice that is delivered again in a later batch,
finds itself in the log and adds nothing. Totals are sparse histograms, whose size does not depend on how many slices
they hold, so a version is rewritten whole; the log has a row a slice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

SLICE = "slice_id"


def running_counts(histograms: DataFrame) -> DataFrame:
    """Totals by all keys of a streaming (or static) table of histogram rows."""
    keys = [c for c in histograms.columns if c not in ("count", SLICE)]
    return histograms.groupBy(*keys).agg(F.sum("count").alias("count"))


def watch_histograms(spark: SparkSession, path: str, schema: str):
    """A stream over a folder into which each slice's histogram is written."""
    return running_counts(spark.readStream.schema(schema).parquet(path))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole versions in a folder, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or ()
    return sorted(int(f.getPath().getName().split("=", 1)[1]) for f in found)


def latest(spark: SparkSession, folder: str) -> int | None:
    return max(_versions(spark, folder), default=None)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The running totals as of the last version."""
    if (version := latest(spark, folder)) is None:
        raise FileNotFoundError(f"{folder}/version=*")
    return spark.read.parquet(f"{folder}/version={version}/totals")


def applied(spark: SparkSession, folder: str) -> DataFrame:
    """(slice_id, batch): the slices in the last version, and the batch that brought each."""
    if (version := latest(spark, folder)) is None:
        raise FileNotFoundError(f"{folder}/version=*")
    return spark.read.parquet(f"{folder}/version={version}/applied")


def add_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Add the slices of a batch (slice_id, keys, count) that the folder's totals don't hold yet; all rows of a slice come in one batch."""
    spark = batch.sparkSession
    version = latest(spark, folder)
    rows = batch.where(F.col(SLICE).isNotNull())
    if version is not None:
        rows = rows.join(applied(spark, folder).select(SLICE), SLICE, "left_anti")
    new = rows.select(SLICE).distinct().withColumn("batch", F.lit(batch_id).cast("long"))
    counts = running_counts(rows)
    if version is not None:
        if new.isEmpty():
            return
        counts = running_counts(counts.unionByName(totals(spark, folder)))
        new = new.unionByName(applied(spark, folder))
    aside = f"{folder}/_writing-{uuid.uuid4().hex}"
    counts.write.parquet(f"{aside}/totals")
    new.write.parquet(f"{aside}/applied")
    jvm = spark._jvm
    source, path = (jvm.org.apache.hadoop.fs.Path(p) for p in (aside, f"{folder}/version={0 if version is None else version + 1}"))
    # fails where another query has written the version: its batch is then replayed on top of that
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(source, path, spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    _forget(spark, folder)


def _forget(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete versions that are older than the last ``keep``; a reader of the one before the last is not disturbed."""
    for version in _versions(spark, folder)[:-keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={version}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def accumulate(histograms: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the totals of a stream (slice_id, keys, count) in ``folder``; start it with the trigger of choice."""
    return histograms.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, folder))
