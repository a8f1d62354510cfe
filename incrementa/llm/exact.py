"""Exact dedup by content-defined chunk recipes.

Each text is cut where a rolling 32-byte hash of its own bytes says so. Chunk bytes move once,
to be deduplicated: the pair (hash, length) of a chunk becomes its identifier only after all
chunks that carry it were found byte-identical (distinct contents are grouped by the bytes
themselves). Should two contents share a pair, each gets a number of its own. Documents are then
compared by their ordered identifier lists, which are about a hundredth of the text.

Edge cases: null text is empty, with an empty list; repeated rows are documents of their own with
the same doc_id, all kept if that id is the largest; a null doc_id never wins over another, and
stays only in a group without ids; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.llm.common import prepare, settle, slices, text_views

WINDOW, LEAST, MOST, MEAN_BITS = 32, 64, 16384, 11
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk starts incl. the end of all bytes, document of each chunk); a cut depends on its own document only."""
    h = _GEAR[body]
    for k in (1, 2, 4, 8, 16):
        step = h.copy()
        step[k:] += h[:-k] << np.uint32(k)
        h = step
    # the last byte is left out: all bytes end there anyway, and no document starts after it
    at = np.flatnonzero(h[:-1] >> np.uint32(32 - MEAN_BITS) == 0) + 1
    doc = np.searchsorted(off, at, side="right") - 1
    at = at[at - off[doc] >= LEAST]
    starts = np.unique(np.concatenate([off[:-1], off[1:], at]))
    gap = np.diff(starts)
    if len(gap) and gap.max() > MOST:
        more = [np.arange(s + MOST, s + g, MOST) for s, g in zip(starts[:-1][gap > MOST].tolist(), gap[gap > MOST].tolist())]
        starts = np.unique(np.concatenate([starts, *more]))
    return starts, np.searchsorted(off, starts[:-1], side="right") - 1


def hashed(batch: pa.RecordBatch, bits: int) -> tuple[bytes, np.ndarray, np.ndarray, list[int], np.ndarray]:
    body, off = text_views(batch.column("text"))
    starts, doc = cuts(body, off)
    raw = body.tobytes()
    view, ends = memoryview(raw), starts.tolist()
    h, mask = xxhash.xxh3_64_intdigest, (1 << bits) - 1
    return raw, off, starts, [h(view[a:b]) & mask for a, b in zip(ends[:-1], ends[1:])], doc


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def chunk_batches(batches: Iterator[pa.RecordBatch], with_place: bool, bits: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, off, starts, digest, doc = hashed(batch, bits)
            h, size = signed(digest), np.diff(starts)
            data = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(raw)])
            columns = [pa.array(h), pa.array(size.astype(np.int32)), data]
            if with_place:
                columns += [batch.column("rid").take(pa.array(doc)), pa.array((np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.int32))]
            yield pa.record_batch(columns, ["h", "size", "data", "rid", "pos"][: len(columns)])


def recipe_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, off, starts, digest, doc = hashed(batch, bits)
            n = batch.num_rows
            first = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            view, ends = memoryview(raw), off.tolist()
            sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
            size = np.diff(starts)
            mixed = pa.array(np.stack([signed(digest), size], 1).ravel() if len(size) else np.zeros(0, np.int64))
            recipe = pa.ListArray.from_arrays(pa.array(2 * first, pa.int32()), mixed)
            names = [c for c in ("rid", "doc_id") if c in batch.schema.names]
            yield pa.record_batch([*map(batch.column, names), recipe, pa.array(sha)], [*names, "recipe", "text_sha256"])


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; ``hash_bits``: of a chunk's hash.

    Where doc_ids repeat, all rows of the largest are ``kept``; number rows beforehand where one has to stay.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = docs.select("text").mapInArrow(lambda it: chunk_batches(it, False, hash_bits), "h long, size int, data binary")
    shared = settle(chunks.groupBy("h", "size", "data").agg(F.lit(1).alias("one")).groupBy("h", "size").agg(F.count("*").alias("n")).where("n > 1"), "clashes")
    if shared.isEmpty():
        key = ["recipe"]
        recipes = settle(docs.mapInArrow(lambda it: recipe_batches(it, hash_bits), "doc_id long, recipe array<long>, text_sha256 string"), "recipes")
    else:
        key = ["recipe", "told"]
        recipes = told_apart(docs, shared, hash_bits)
    groups = settle(recipes.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    return recipes.join(groups, key, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        "text_sha256",
    )


def told_apart(docs: DataFrame, shared: DataFrame, hash_bits: int) -> DataFrame:
    """Recipes with ``told``: the numbers of a row's chunks whose (hash, length) stands for several contents.

    Rows are numbered in a settled copy, as doc_ids may repeat or be missing.
    """
    copy = settle(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")
    recipes = copy.mapInArrow(lambda it: recipe_batches(it, hash_bits), "rid long, doc_id long, recipe array<long>, text_sha256 string")
    placed = copy.select("rid", "text").mapInArrow(lambda it: chunk_batches(it, True, hash_bits), "h long, size int, data binary, rid long, pos int")
    placed = settle(placed.join(shared.select("h", "size"), ["h", "size"]), "clashing")
    contents = placed.groupBy("h", "size", "data").agg(F.lit(1).alias("one"))
    number = contents.select("h", "size", "data", F.row_number().over(W.partitionBy("h", "size").orderBy("data")).alias("number"))
    told = placed.join(number, ["h", "size", "data"]).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("told"))
    return settle(recipes.join(told, "rid", "left").select("doc_id", "recipe", "text_sha256", F.coalesce("told", F.array().cast("array<struct<pos:int,number:int>>")).alias("told")), "told")
