"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

A token file is a Parquet table of self-contained blocks. A block holds consecutive documents of
one contiguous doc_id range: a header, the documents' lengths, then for all its ids one control
byte for every four ids (two bits each: bytes used, less one) and, apart from those, the data
bytes. What is coded is an id's rank by frequency over the whole corpus, so that the 256 commonest
ids take one byte. The rank table lies beside the blocks. Decoding looks control bytes up in a
table of lengths with numpy.

Edge cases: null text is empty, its document then holds the end id alone; documents of equal
doc_id stay apart, ordered by their ids; null doc_ids come first; an empty table gives an empty
file. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.llm.common import fresh_path, heaps, partitions, prepare, settle
from incrementa.llm.tokens import Encoder, vocabulary_path

MAGIC = 0x32424B54
BLOCK_IDS = 1 << 20
#: bytes of text whose distinct pieces are looked up together
HEAP_BYTES = 5 << 20
#: bytes used by each of the four ids of a control byte
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :] & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    # values of two bytes at most, as ranks of small vocabularies are, are cut from half as many bytes
    narrow = not len(values) or int(values.max()) <= 0xFFFF
    size = (values > 0xFF).astype(np.uint8)
    if not narrow:
        size += (values > 0xFFFF).astype(np.uint8) + (values > 0xFFFFFF)
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[: len(values)] = size
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    each = values.astype("<u2" if narrow else "<u4").view(np.uint8).reshape(-1, 2 if narrow else 4)
    used = np.arange(each.shape[1], dtype=np.uint8)[None, :] <= size[:, None]
    return control.tobytes(), each[used].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that :func:`pack` coded."""
    size = _LENGTHS[control].ravel()[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    out = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    lengths = np.array([len(d) for d in docs], "<u4")
    control, data = pack(np.concatenate(docs))
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    # null doc_ids come first in a file, so their number tells which they are
    head = np.array([MAGIC, len(docs), lengths.sum(), len(control), len(data), sum(d is None for d in doc_ids)], "<u4")
    return b"".join((head.tobytes(), ids.tobytes(), lengths.tobytes(), control, data))


def read_block(block: bytes) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(doc_ids, how many of the first are null, lengths, ranks of all ids) of a block."""
    magic, n, total, n_control, n_data, nulls = np.frombuffer(block, "<u4", 6).tolist()
    if magic != MAGIC:
        raise ValueError("not a token block")
    ids = np.frombuffer(block, "<i8", n, 24)
    lengths = np.frombuffer(block, "<u4", n, 24 + 8 * n)
    at = 24 + 12 * n
    control = np.frombuffer(block, np.uint8, n_control, at)
    return ids, nulls, lengths, unpack(control, np.frombuffer(block, np.uint8, n_data, at + n_control), total)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Ids of each document, in order; a last row holds the task's counts of all ids."""
    encoder = Encoder.of(path)
    end = np.array([end_id], encoder.dtype).tobytes()
    part, seq, total = TaskContext.get().partitionId(), 0, np.zeros(max(encoder.vocabulary, end_id + 1), np.int64)
    names = ["doc_id", "part", "seq", "ids", "counts"]
    for batch in heaps(batches, "text", HEAP_BYTES):
        ids = [x + end for x in encoder.encode(batch.column("text"))]
        n = len(ids)
        total += np.bincount(np.frombuffer(b"".join(ids), encoder.dtype), minlength=len(total))
        yield pa.record_batch([batch.column("doc_id"), pa.array([part] * n, pa.int32()), pa.array(np.arange(seq, seq + n)), pa.array(ids, pa.binary()), pa.nulls(n, pa.binary())], names)
        seq += n
    if seq:
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column("counts").to_pylist():
            total = np.frombuffer(x, "<i8") + (total if len(total) else 0)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])


def block_batches(batches: Iterator[pa.RecordBatch], dtype: str, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in (part, seq) order within a file; a block ends where that order breaks or it is full."""
    docs: list[np.ndarray] = []
    ids: list[int | None] = []
    begun, held = (0, 0), 0

    def emit() -> pa.RecordBatch:
        return pa.record_batch([pa.array([begun[0]], pa.int32()), pa.array([begun[1]], pa.int64()), pa.array([held], pa.int64()), pa.array([write_block(ids, docs)], pa.binary())], ["part", "first_seq", "n_tokens", "block"])

    for batch in batches:
        for doc_id, part, seq, x in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("ids")):
            if docs and (part != begun[0] or seq != begun[1] + len(docs) or held >= BLOCK_IDS):
                yield emit()
                docs, ids, held = [], [], 0
            if not docs:
                begun = (part, seq)
            ranked = rank[np.frombuffer(x.as_buffer(), dtype)]
            docs.append(ranked)
            ids.append(doc_id)
            held += len(ranked)
    if docs:
        yield emit()


def write_token_file(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, path: str | None = None) -> str:
    """Write the token file of ``docs(doc_id, text)`` in ascending doc_id order; returns its path."""
    spark = docs.sparkSession
    prepare(spark)
    tokenizer, path = tokenizer or vocabulary_path(), path or fresh_path(spark, "tokens")
    encoder = Encoder.of(tokenizer)
    dtype, vocabulary = encoder.dtype.str, max(encoder.vocabulary, end_id + 1)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = docs.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    raw = settle(ranged.mapInArrow(lambda it: encode_batches(it, tokenizer, end_id), "doc_id long, part int, seq long, ids binary, counts binary"), "ids", "lz4")
    counts = raw.select("counts").where("counts is not null").mapInArrow(count_batches, "id int, n long")
    # at most one row an id of the vocabulary reaches the driver
    order = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy(np.uint32)
    rank = np.zeros(vocabulary, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    raw.where("seq >= 0").select("doc_id", "part", "seq", "ids").mapInArrow(lambda it: block_batches(it, dtype, rank), "part int, first_seq long, n_tokens long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(order.astype("<u4").tobytes(), end_id)], "ids binary, end_id int").coalesce(1).write.parquet(f"{path}/ranks")
    return path


def decode_batches(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, block in zip(batch.column("part"), batch.column("first_seq"), batch.column("block")):
            doc_ids, nulls, lengths, ranks = read_block(block.as_buffer())
            ids = order[ranks].astype("<u4")
            end = np.cumsum(lengths, dtype=np.int64)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), lengths.tolist())]
            n = len(doc_ids)
            yield pa.record_batch(
                [pa.array(doc_ids, mask=np.arange(n) < nulls), pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int64()), pa.array(end - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "first_seq", "inside", "n_tokens", "ids_crc32"],
            )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks at ``path``."""
    prepare(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    order = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()["ids"], "<u4")
    sizes = blocks.select("part", "first_seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a file
    begun = sizes.join(parts, "part").select("part", "first_seq", (F.col("before") + F.sum("n_tokens").over(W.partitionBy("part").orderBy("first_seq")) - F.col("n_tokens")).alias("begun"))
    begun = settle(begun, "begun")
    docs = blocks.select("part", "first_seq", "block").mapInArrow(lambda it: decode_batches(it, order), "doc_id long, part int, first_seq long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(begun, ["part", "first_seq"]).select("doc_id", (F.col("begun") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
