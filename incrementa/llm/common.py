"""Shared plumbing: durable intermediate tables, Arrow batch access, id-graph components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
_LOCAL_ROOT: list[str] = []
_SETTLED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver's path has it, and bound an Arrow batch.

    Texts run to hundreds of kilobytes, so a batch of the default 10,000 rows could outgrow a worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one only where that is unset and all is one machine's process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="incrementa-"))
    return "file://" + _LOCAL_ROOT[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage with replicated files rather than executor-local blocks, so a lost
    executor never forces (or forbids) recomputing what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _SETTLED[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table once all that was made of it has been written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop(df))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text is about ``most_bytes``; a longer row stands alone."""
    _, off = text_views(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most_bytes, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def heaps(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 5 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until their text is about ``most_bytes``, and cut where it is more."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(text_views(batch.column(column))[1][-1])
        if size >= most_bytes // 2:
            yield from slices(pa.Table.from_batches(held).combine_chunks().to_batches()[0], column, most_bytes)
            held, size = [], 0
    if held and (joined := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield from slices(joined[0], column, most_bytes)


ROW = "__row"


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(``docs`` with a unique number ``__row`` of each row, whether that is its doc_id).

    Where ids repeat or are missing, the number is the row's place by doc_id (null first) and text, in a settled copy.
    """
    number = F.col("doc_id").cast("long")
    if docs.groupBy(number.alias("n")).count().where("n is null or count > 1").isEmpty():
        return docs.withColumn(ROW, number), True
    order = [number.asc_nulls_first(), F.xxhash64("text")]
    placed = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    return settle(placed.withColumn(ROW, F.monotonically_increasing_id()), "rows"), False


def placed(ranged: DataFrame) -> DataFrame:
    """A settled copy of a range-partitioned, sorted table with ``__part`` and ``__at``, a row's place in its part."""
    m = F.monotonically_increasing_id()
    return settle(ranged.withColumns({"__part": F.shiftright(m, 33), "__at": m.bitwiseAND(F.lit((1 << 33) - 1))}), "placed")


def numpy_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes over undirected links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)``: one row (node, root) per linked node, root the smallest node.

    Alternates large-star and small-star rounds. Each round is two grouped minima (combined
    map-side) and two equi-joins whose skew AQE can split; no node's neighbours are gathered.
    """
    edges = settle(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = settle(both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = settle(small.where("a <> b").distinct(), "small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
