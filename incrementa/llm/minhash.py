"""MinHash near-duplicate groups by tensored banding, with exact verification.

Each text's set of distinct shingles is signed by ``collections`` short keys of ``rows`` least hashes each. A table is
a pair of collections: two texts meet where two of their keys agree, so 16 collections of 3 rows, 48 least hashes,
make 120 tables of 6 rows that plain banding would compute 720 for. At a similarity of 0.8 a pair is missed with
probability 1.8e-4 by the tables; it is still compared where other texts connect the two.

Equal sets are one node. In a table each node is joined to the least node of its key, which connects all that meet there
with a link each, whatever their number; connected nodes are a cluster. Within a cluster every pair whose sizes admit a
link is compared exactly, on full sets: nodes are filed by size class, classes apart cannot reach the similarity, and a class
too large for a task is cut to slices, every two of which meet in a task of their own. Only a spanning set of links
leaves a task. What a task holds is bounded by the slice.

Edge cases: null text has no shingles; a text without words is empty and linked with nothing; fewer words than
``width`` make one shingle; repeated rows are linked by their equal set; a null doc_id links like any other,
and a group's component_id is its least doc_id that is not null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incrementa.llm.common import ROW, components, numbered, numpy_components, prepare, settle, slices, text_views

#: nodes and shingles of a slice
SLICE_NODES, SLICE_SHINGLES = 1024, 2 << 20


class Tables(NamedTuple):
    """Shingle width, percentage of similarity, number of collections and least hashes in each."""

    width: int = 2
    percent: int = 80
    collections: int = 16
    rows: int = 3

    @property
    def missed(self) -> float:
        """Chance that fewer than two collections agree for two sets right at the similarity."""
        p, m = (self.percent / 100) ** self.rows, self.collections
        return (1 - p) ** m + m * p * (1 - p) ** (m - 1)


def shingle_set(body: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles."""
    words = body.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        found = {b" ".join(words)}
    else:
        found = set(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit mix of ``h``, another for each ``k``."""
    h = (h + np.uint64(2 * k + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def signed_batches(batches: Iterator[pa.RecordBatch], tables: Tables) -> Iterator[pa.RecordBatch]:
    """Number, doc_id, size, 128-bit digest and one key a collection of each text's set."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            body, off = text_views(batch.column("text"))
            raw = body.tobytes()
            sets = [shingle_set(raw[a:b], tables.width) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            size = np.array([len(s) for s in sets], np.int64)
            full, every = size > 0, np.concatenate(sets)
            at = (np.cumsum(size) - size)[full]
            keys = np.zeros((len(sets), tables.collections), np.uint64)
            for c in range(tables.collections if len(at) else 0):
                for r in range(tables.rows):
                    keys[full, c] = mixed(keys[full, c] + np.minimum.reduceat(mixed(every, 2 + c * tables.rows + r), at), 1)
            told = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            x, y = (np.array([v >> shift & (1 << 64) - 1 for v in told], np.uint64).view(np.int64) for shift in (0, 64))
            ends = np.arange(len(sets) + 1, dtype=np.int32) * tables.collections
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64).ravel()))
            yield pa.record_batch([batch.column(ROW), batch.column("doc_id"), pa.array(size), pa.array(x), pa.array(y), lists], ["row", "doc_id", "m", "x", "y", "keys"])


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            body, off = text_views(batch.column("text"))
            raw = body.tobytes()
            sets = [shingle_set(raw[a:b], width) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.record_batch([batch.column(ROW), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def clusters(nodes: DataFrame, tables: Tables) -> DataFrame:
    """(node, cluster) of the nodes that meet another in some table, connected through all tables."""
    m = tables.collections
    first = nodes.select("node", "keys", F.posexplode("keys").alias("i", "a")).where(F.col("i") < m - 1)
    filed = first.select("node", "i", "a", F.posexplode(F.slice("keys", F.col("i") + 2, F.lit(m))).alias("j", "b"))
    filed = filed.select("node", F.xxhash64("i", "j", "a", "b").alias("key"))
    met = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("key", "least")
    links = filed.join(met, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = components(links)
    # a root has no row of its own unless it is linked to itself
    return found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("root", "cluster")


def overlaps(node: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each two of ``n`` nodes share, over places (node, shingle)."""
    order = np.argsort(shingle, kind="stable")
    node, shingle = node[order], shingle[order]
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    at = np.flatnonzero(new)
    df = np.diff(np.append(at, len(shingle)))
    shared = np.zeros((n, n), np.float32)
    common = df > max(4, n // 16)
    # shingles of many nodes: a product of incidence matrices, a block of shingles at a time
    wide = np.flatnonzero(common)
    for a in range(0, len(wide), 2048):
        part = wide[a : a + 2048]
        column = np.repeat(np.arange(len(part)), df[part])
        places = np.repeat(at[part] - (np.cumsum(df[part]) - df[part]), df[part]) + np.arange(df[part].sum())
        has = np.zeros((n, len(part)), np.float32)
        has[node[places], column] = 1
        shared += has @ has.T
    # shingles of few: their pairs, by distance in the sorted list
    few = np.repeat(~common, df)
    group = np.cumsum(new) - 1
    for lag in range(1, int(df[~common].max(initial=1))):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & few[lag:])
        np.add.at(shared, (node[i], node[i + lag]), 1)
        np.add.at(shared, (node[i + lag], node[i]), 1)
    return shared


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i > j) of sets whose intersection is ``percent`` % of their union or more."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        # both sets are sorted and distinct: an element met again is shared
        both = np.sort(np.concatenate(sets))
        both = int((both[1:] == both[:-1]).sum())
        hit = 100 * both >= percent * (int(size.sum()) - both)
        return (np.array([1]), np.array([0])) if hit else (np.zeros(0, np.int64),) * 2
    shared = overlaps(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets)).astype(np.int64)
    hit = (100 + percent) * shared >= percent * (size[:, None] + size[None, :])
    return np.nonzero(np.tril(hit, -1))


def link_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (cluster, cls, p, q), each node once in a task; a spanning set of links (a, b)."""
    task, nodes, sets = None, [], []
    left, right = [], []

    def solve() -> None:
        if len(nodes) > 1:
            i, j = linked(sets, percent)
            root = numpy_components(len(nodes), i, j)
            ids = np.array(nodes)
            far = np.flatnonzero(root != np.arange(len(ids)))
            left.extend(ids[far].tolist())
            right.extend(ids[root[far]].tolist())

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "cls", "p", "q")))
        for k, node, data in zip(keys, batch.column("node").to_pylist(), batch.column("shingles")):
            if k != task:
                solve()
                task, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(np.frombuffer(data.as_buffer(), "<u8"))
        if len(left) >= 4096:
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
            left.clear(), right.clear()
    solve()
    yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def verified(members: DataFrame, percent: int) -> DataFrame:
    """Spanning links (a, b) among ``members(node, cluster, m, shingles)``: all pairs of a cluster that can be linked are compared.

    A size class holds sizes within the similarity of its least, so linked sets are in the same class or in adjacent ones.
    A task of class c holds the class and the next; where that is too much, two slices of it at a time.
    """
    cls = F.floor(F.log(F.col("m").cast("double")) / F.lit(-math.log(percent / 100)) + 1e-9).cast("int")
    members = members.withColumn("own", cls)
    near = members.select("node", "cluster", "m", "own", F.explode(F.array("own", F.col("own") - 1)).alias("cls"))
    sizes = near.groupBy("cluster", "cls").agg(F.count("*").alias("n"), F.sum("m").alias("total"), F.min("own").alias("lo"))
    parts = F.greatest(F.ceil(F.col("n") / SLICE_NODES), F.ceil(F.col("total") / SLICE_SHINGLES)).cast("int")
    # a task without a node of its own class has nothing that its neighbour's task lacks
    sizes = sizes.where("n > 1 and lo = cls").select("cluster", "cls", parts.alias("parts"))
    filed = near.select("node", "cluster", "cls").join(sizes, ["cluster", "cls"])
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = filed.select("node", "cluster", "cls", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("node", "cluster", "cls", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    met = tiles.join(members.select("node", "shingles"), "node")
    keys = ["cluster", "cls", "p", "q"]
    return met.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lambda it: link_batches(it, percent), "a long, b long")


def minhash_groups(docs: DataFrame, tables: Tables = Tables()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable, itself included), kept."""
    prepare(docs.sparkSession)
    rows, by_id = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = rows.select(ROW, "doc_id", "text")
    signed = settle(rows.mapInArrow(lambda it: signed_batches(it, tables), "row long, doc_id long, m long, x long, y long, keys array<long>"), "signed")
    nodes = settle(signed.where("m > 0").groupBy("x", "y", "m").agg(F.min("row").alias("node"), F.first("keys").alias("keys")), "nodes")
    cluster = settle(clusters(nodes.select("node", "keys"), tables).join(nodes.select("node", "m"), "node"), "clusters")
    texts = rows.join(cluster.select(F.col("node").alias(ROW)), ROW, "left_semi")
    sets = texts.select(ROW, "text").mapInArrow(lambda it: set_batches(it, tables.width), "node long, shingles binary")
    members = settle(cluster.join(sets, "node"), "members")
    roots = components(verified(members, tables.percent))
    named = nodes.join(roots, "node", "left").select("x", "y", "m", F.coalesce("root", "node").alias("root"))
    out = signed.drop("keys").join(named, ["x", "y", "m"], "left").withColumn("root", F.coalesce("root", "row"))
    if by_id:
        return _result(out, F.col("root"))
    out = settle(out, "rooted")
    least = out.groupBy("root").agg(F.min("doc_id").alias("least"))
    return _result(out.join(least, "root"), F.col("least"))


def _result(out: DataFrame, component: Column) -> DataFrame:
    return out.select("doc_id", F.col("m").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
