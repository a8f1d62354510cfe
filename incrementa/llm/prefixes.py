"""Prefix trie of rebuilt conversations by smallest-member ownership.

A node of the trie is a distinct sequence of first turns; it is named by its depth and the exclusive-or of 128-bit
digests of its turns with their places, so a running exclusive-or along a conversation names all its prefixes.
The smallest member of a node owns it. Members only become fewer with depth, so each conversation owns a suffix of
its own path, told by its first owned depth. Everything asked of a subtree is then one sum over the occurrences of
its top: bytes from the top on less bytes the conversation owns, one for an owned leaf, one for an owned child.

The sums run by prefix and are combined within tasks, so a turn that opens a third of all conversations costs no more
than another. Owners are found by a grouped minimum, not by a window over a node's members, for that reason; windows
run along conversations only, in chunks of 1,024 turns whose totals are carried. Rows are ordered by range partitioning,
which splits a long conversation. A node's list of ends is hashed in order, as it must be, but from pieces
that were joined where the ids lay sorted.

Edge cases: rows of a null conv_id belong to no conversation and are left out; null role or text is empty; null turns
come first; rows of equal turn are ordered by role and text, repeated rows are turns of their own; a conversation
whose rebuilt form has no turns is a member of the root alone; an empty table gives no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.llm.common import partitions, placed, prepare, settle

CHUNK = 1 << 10
PIECE_BYTES = 1 << 16
#: fixed values: conversations of a family, and the most turns taken from its first
FAMILY, MOST_SHARED = 5, 9
KEY = ["depth", "x", "y"]


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns (conv_id, place, role, text), conversations (conv_id, n, base, h)), both settled; places from 0."""
    texts = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    # bounds of the ranges come to the driver, so only the beginning of a text is part of them
    ranged = texts.where("conv_id is not null").repartitionByRange(partitions(conversations.sparkSession), *order, F.substring("text", 1, 32))
    rows = placed(ranged.sortWithinPartitions(*order, "text").select("conv_id", "role", "text"))
    runs = settle(rows.groupBy("conv_id", "__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")), "runs")
    before = runs.select("conv_id", "__part", (F.sum("n").over(W.partitionBy("conv_id").orderBy("__part")) - F.col("n") - F.col("first")).alias("shift"))
    turns = rows.join(before, ["conv_id", "__part"]).select("conv_id", (F.col("__at") + F.col("shift")).alias("place"), "role", "text")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    return settle(turns, "turns"), settle(convs, "conversations")


def named(depth: Column) -> list[Column]:
    """Two halves of a digest of a turn and its depth."""
    text = F.concat(depth.cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text"))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(c) for at, c in ((1, "x"), (17, "y"))]


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, x, y): the turns of every rebuilt conversation, depths from 1."""
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = convs.join(lengths, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("shared"))
    size = F.octet_length("text").cast("long").alias("bytes")
    opening = turns.where(F.col("place") < MOST_SHARED - 1).withColumnRenamed("conv_id", "base")
    taken = known.join(opening, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    own = turns.join(known.select("conv_id", "h", "shared"), "conv_id").where("place >= h").select("conv_id", (F.col("shared") + F.col("place") - F.col("h") + 1).alias("depth"), "role", "text")
    return taken.unionByName(own).select("conv_id", "depth", size, *named(F.col("depth")))


def occurrences(elements: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, last, before, total, length): every prefix of every conversation, the root too, settled.

    last: bytes of its last turn; before: bytes of the turns before that; total, length: bytes and turns of the whole.
    """
    every = elements.unionByName(convs.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("depth", "bytes", "x", "y"))))
    every = every.withColumn("chunk", F.shiftright("depth", CHUNK.bit_length() - 1))
    sums = every.groupBy("conv_id", "chunk").agg(F.sum("bytes").alias("cb"), *(F.bit_xor(c).alias(f"c{c}") for c in "xy"), F.max("depth").alias("deepest"))
    by = W.partitionBy("conv_id")
    upto, whole = by.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = sums.select("conv_id", "chunk", *(F.coalesce(v, F.lit(0)).alias(n) for v, n in ((F.sum("cb").over(upto), "cb"), (F.bit_xor("cx").over(upto), "cx"), (F.bit_xor("cy").over(upto), "cy"))), F.sum("cb").over(whole).alias("total"), F.max("deepest").over(whole).alias("length"))
    along = W.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    ran = every.select("conv_id", "chunk", "depth", F.col("bytes").alias("last"), F.sum("bytes").over(along).alias("b"), *(F.bit_xor(c).over(along).alias(c) for c in "xy"))
    got = ran.join(carried, ["conv_id", "chunk"])
    return settle(got.select("conv_id", "depth", *(F.col(c).bitwiseXOR(F.col(f"c{c}")).alias(c) for c in "xy"), "last", (F.col("cb") + F.col("b") - F.col("last")).alias("before"), "total", "length"), "occurrences")


def owners(occ: DataFrame, elements: DataFrame, slices: int) -> DataFrame:
    """(conv_id, o, before_o, leaf, above): for each conversation that owns a node, the first depth it owns, the bytes before it, whether its end is a leaf of its own, and the owner of the node above."""
    nodes = settle(occ.groupBy(*KEY).agg(F.min(F.struct("conv_id", "before")).alias("m"), F.max("length").alias("deepest")).select(*KEY, F.col("m.conv_id").alias("conv_id"), F.col("m.before").alias("before"), (F.col("deepest") == F.col("depth")).alias("leaf")), "nodes")
    first = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before", "x", "y")).alias("f"), F.max(F.col("leaf").cast("int")).alias("leaf"))
    first = first.select("conv_id", F.col("f.depth").alias("o"), F.col("f.before").alias("before_o"), "leaf", F.col("f.x").alias("fx"), F.col("f.y").alias("fy"))
    # the key above is the key without the turn at its depth
    turn = elements.select("conv_id", F.col("depth").alias("o"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    asked = settle(first.join(turn, ["conv_id", "o"], "left").select("conv_id", "o", "before_o", "leaf", (F.col("o") - 1).alias("depth"), F.col("fx").bitwiseXOR(F.col("tx")).alias("x"), F.col("fy").bitwiseXOR(F.col("ty")).alias("y"), F.pmod("conv_id", F.lit(slices)).alias("slice")), "asked")
    # a node above many: asked for once a slice, not once a conversation
    answers = asked.where("depth >= 0").select(*KEY, "slice").distinct().join(nodes.select(*KEY, F.col("conv_id").alias("above")), KEY)
    return settle(asked.join(answers, [*KEY, "slice"], "left").select("conv_id", "o", "before_o", "leaf", "above"), "owners")


def piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation: ids of a node joined to pieces, with the first of each."""
    key, first, ids, size = None, 0, [], 0
    out: list[tuple] = []

    def cut() -> None:
        if ids:
            out.append((*key, first, b",".join(ids)))

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()])]
        return pa.record_batch(columns, [*KEY, "first", "ids"])

    for batch in batches:
        for *k, c in zip(*(batch.column(n).to_pylist() for n in [*KEY, "conv_id"])):
            if k != key or size >= PIECE_BYTES:
                cut()
                key, first, ids, size = k, c, [], 0
            text = b"%d" % c
            ids.append(text)
            size += len(text) + 1
        if len(out) >= 4096:
            yield flush()
            out = []
    cut()
    if out:
        yield flush()


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first conversation: one digest a node, fed piece by piece."""
    key, told = None, None
    for batch in batches:
        out = []
        for *k, ids in zip(*(batch.column(n).to_pylist() for n in KEY), batch.column("ids")):
            if k != key:
                if told is not None:
                    out.append((*key, told.hexdigest()))
                key, told = k, hashlib.sha256()
            else:
                told.update(b",")
            told.update(ids.as_buffer())
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], [*KEY, "ends_sha256"])
    if told is not None:
        yield pa.record_batch([pa.array([v]) for v in (*key, told.hexdigest())], [*KEY, "ends_sha256"])


def end_digests(occ: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the nodes at which conversations end: SHA-256 of their ids, ascending, joined by commas."""
    order = [*KEY, "conv_id"]
    ends = occ.where("depth = length").select(*order)
    pieces = ends.repartitionByRange(partitions(occ.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(piece_batches, "depth long, x long, y long, first long, ids binary")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest_batches, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    prepare(spark)
    turns, convs = ordered_turns(conversations)
    elements = settle(rebuilt(turns, convs), "elements")
    occ = occurrences(elements, convs)
    own = owners(occ, elements, partitions(spark))
    known = occ.join(own, "conv_id", "left")
    rest = F.greatest(F.coalesce("before_o", "total") - F.col("before"), F.lit(0))
    child = (F.coalesce(F.col("o") <= F.col("depth") + 1, F.lit(False)) & (F.col("depth") < F.col("length"))).cast("long")
    nodes = known.groupBy(*KEY).agg(F.min(F.struct("conv_id", "o", "above")).alias("m"), F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"), F.sum(rest).alias("saved_tokens"))
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("m.o"), F.col("m.conv_id")).otherwise(F.col("m.above")))
    none = F.lit(hashlib.sha256().hexdigest())
    out = nodes.join(end_digests(occ), KEY, "left")
    return out.select(F.col("m.conv_id").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
