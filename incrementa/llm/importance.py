"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Runs of one to ``width`` words are hashed to buckets. Both corpora are turned into postings (bucket, document,
count), shuffled by bucket in blocks: a block holds the postings of one batch of texts for one group of buckets.
A group's blocks meet both corpora's counts of its buckets in the same task (the counts come first, the blocks
follow one at a time), which computes the gains of its buckets and emits what they contribute to each document.
Contributions are summed by document, with Gumbel noise keyed by doc_id the score is a draw without replacement,
and the ranks of the drawn come from one range partitioning.

A very common bucket holds a posting of every document: a group is therefore dealt to many slices, by batch of
texts, each of which gets the group's counts. Counts are summed within a task before they are shuffled; what a
task holds is a group's counts (``buckets`` / GROUPS) and one block.

Edge cases: null text has no words; without words the weight is 0; a null doc_id is drawn with the key of an
empty id and comes last among equal scores; rows of equal doc_id are rows of their own; an empty target (T = 0)
has t = 0 throughout; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.llm.common import ROW, numbered, partitions, placed, prepare, settle, slices, text_views

GROUPS = 16
BLOCK_BYTES = 4 << 20
#: distinct features of which a task remembers the bucket
KNOWN = 1 << 20
#: bytes of a word as they are, A-Z in lower case, all else a blank
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
POSTINGS = "grp int, slice int, n_words long, n_features long, row long, doc_id long, block binary, sums binary"
NAMES = [f.split()[0] for f in POSTINGS.split(", ")]


class Buckets(dict):
    """Bucket of a feature's bytes, remembered."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def features(text: bytes, width: int) -> tuple[list[bytes], int]:
    """(all runs of 1 to ``width`` words, number of words) of a text's bytes."""
    words = text.translate(_WORD).split(b" ")
    words = [w for w in words if w]
    runs = words + [b" ".join(x) for k in range(2, width + 1) for x in zip(*(words[i:] for i in range(k)))]
    return runs, len(words)


def written(row: np.ndarray, bucket: np.ndarray, doc: np.ndarray, count: np.ndarray) -> bytes:
    """A block: rows of its documents, then postings as (bucket, document's place, count)."""
    used, place = np.unique(doc, return_inverse=True)
    head = np.array([len(used), len(bucket)], "<i8")
    return b"".join((head.tobytes(), row[used].astype("<i8").tobytes(), bucket.astype("<u4").tobytes(), place.astype("<u4").tobytes(), count.astype("<u4").tobytes()))


def read(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, bucket, document's place, count) of a block."""
    n, m = np.frombuffer(block, "<i8", 2).tolist()
    at = 16 + 8 * n
    return np.frombuffer(block, "<i8", n, 16), *(np.frombuffer(block, "<u4", m, at + 4 * m * k) for k in range(3))


def posting_batches(batches: Iterator[pa.RecordBatch], buckets: int, width: int, spread: int, blocks: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document, a row for each block of postings, and at the end the task's counts by bucket."""
    known, sums = Buckets(buckets), np.zeros(buckets, np.int64)
    part, seq = TaskContext.get().partitionId(), 0

    def rows(n: int, **given: object) -> pa.RecordBatch:
        kinds = [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary()] * 2
        return pa.record_batch([pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(NAMES, kinds)], NAMES)

    for whole in batches:
        for batch in slices(whole, "text", BLOCK_BYTES):
            body, off = text_views(batch.column("text"))
            raw, found, length, n_words = body.tobytes(), [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                runs, words = features(raw[a:b], width)
                found += map(known.__getitem__, runs)
                length.append(len(runs))
                n_words.append(words)
            bucket, length = np.array(found, np.int64), np.array(length, np.int64)
            sums += np.bincount(bucket, minlength=buckets)
            if not blocks:
                continue
            n, row = batch.num_rows, batch.column(ROW).to_numpy()
            yield rows(n, n_words=n_words, n_features=length, row=row, doc_id=batch.column("doc_id"))
            # by group, then bucket, then document
            key, count = np.unique((bucket % GROUPS * buckets + bucket) * n + np.repeat(np.arange(n), length), return_counts=True)
            cell, doc = np.divmod(key, n)
            group = cell // buckets
            ends = np.searchsorted(group, np.arange(GROUPS + 1))
            made = [(g, written(row, cell[a:b] % buckets, doc[a:b], count[a:b])) for g, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            if made:
                yield rows(len(made), grp=[g for g, _ in made], slice=[zlib.crc32(b"%d,%d" % (part, seq)) % spread] * len(made), block=[x for _, x in made])
            seq += 1
    yield rows(1, sums=[sums.astype("<i8").tobytes()])


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bucket of the tasks' arrays that came to this task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for x in batch.column("sums").to_pylist():
            total = np.frombuffer(x, "<i8") + (total if len(total) else 0)
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """A bucket's gain: a thousandth of the smoothed log ratio of its shares, floored."""
    ratio = ((t + 1.0) * (all_s + float(buckets))) / ((s + 1.0) * (all_t + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def contribution_batches(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and slice, counts of both corpora first; what each block's postings are worth, by document."""
    at, gain = None, np.zeros(buckets, np.int64)
    for batch in batches:
        for grp, sl, counts, block in zip(*(batch.column(c) for c in ("grp", "slice", "counts", "block"))):
            where = (grp.as_py(), sl.as_py())
            if counts.is_valid:
                c = np.array([[x["bucket"], x["s"], x["t"], x["all_s"], x["all_t"]] for x in counts.as_py()], np.int64).T
                at = where
                gain[c[0]] = gains(c[1], c[2], int(c[3][0]), int(c[4][0]), buckets)
                continue
            if where != at:
                raise ValueError("a block came without its group's counts")
            row, bucket, doc, count = read(block.as_buffer())
            worth = np.zeros(len(row), np.int64)
            np.add.at(worth, doc, gain[bucket] * count)
            yield pa.record_batch([pa.array(row), pa.array(worth)], ["row", "weight"])


def bucket_counts(table: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``) of settled postings, summed within each task first; at most a row a bucket."""
    found = table.select("sums").where("sums is not null").mapInArrow(sum_batches, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias(name))


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10000, width: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``: the sum of its features' gains towards ``target``."""
    spark = docs.sparkSession
    prepare(spark)
    rows, _ = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    parts = partitions(spark)
    spread = max(1, parts // 4)
    made = settle(rows.select(ROW, "doc_id", "text").mapInArrow(lambda it: posting_batches(it, buckets, width, spread, True), POSTINGS), "postings")
    aim = target.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: posting_batches(it, buckets, width, 1, False), POSTINGS)
    both = bucket_counts(made, "s").join(bucket_counts(aim, "t"), "bucket", "full").select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in "st"))
    both = settle(both, "bucket-counts")
    all_s, all_t = (x or 0 for x in both.agg(F.sum("s"), F.sum("t")).first())
    held = F.struct("bucket", "s", "t", F.lit(all_s).cast("long").alias("all_s"), F.lit(all_t).cast("long").alias("all_t"))
    # buckets / GROUPS of them a row
    counts = both.groupBy((F.col("bucket") % GROUPS).alias("grp")).agg(F.collect_list(held).alias("counts"))
    counts = counts.select("grp", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("slice"), "counts", F.lit(None).cast("binary").alias("block"))
    blocks = made.where("block is not null").select("grp", "slice", F.lit(None).cast(counts.schema["counts"].dataType).alias("counts"), "block")
    met = counts.unionByName(blocks).repartition(parts, "grp", "slice").sortWithinPartitions("grp", "slice", F.col("counts").isNull())
    worth = met.mapInArrow(lambda it: contribution_batches(it, buckets), "row long, weight long")
    heads = made.where("row is not null").select("row", "doc_id", "n_words", "n_features", F.lit(0).cast("long").alias("weight"))
    none = F.lit(None).cast("long")
    every = heads.unionByName(worth.select("row", none.alias("doc_id"), none.alias("n_words"), none.alias("n_features"), "weight"))
    return every.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")), F.sum("weight").alias("weight")).drop("row")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise of a document, in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``scored`` with ``rank``, 1 for the highest score, of the best ``percent`` % of the eligible rows; null for all others."""
    spark = scored.sparkSession
    scored = settle(scored.withColumn("__out", ~eligible), "scored")
    drawn = scored.where("not __out").count() * percent // 100
    order = [F.col("__out"), F.desc("score"), F.col("doc_id").asc_nulls_last()]
    sorted_rows = placed(scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, *(c for c in scored.columns if c not in ("__out", "score", "doc_id"))))
    parts = sorted_rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = parts.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("before"))  # a row a part
    place = F.col("before") + F.col("__at") + 1
    out = sorted_rows.join(before, "__part").withColumn("rank", F.when(~F.col("__out") & (place <= drawn), place))
    return out.drop("__out", "__part", "__at", "before")


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = 10000, width: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``percent`` % of the rows of ``least_words`` or more drawn by importance."""
    scored = weights(docs, target, buckets, width).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scored, F.col("n_words") >= least_words, percent)
