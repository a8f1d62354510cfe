"""SimHash near-duplicate groups by exact tiled comparison of 64-bit fingerprints.

Fingerprints of equal value are one node. Candidate tiles come from an exact covering: the
64 bits are cut into ``radius + 2`` blocks and two fingerprints within the radius agree on at
least two of them, so each fingerprint is filed once under every pair of blocks. Inside a
bucket, tiles sorted by population count are compared with numpy exclusive-or and bit counts;
tile pairs whose population counts differ by more than the radius are skipped. A bucket larger
than a tile is split over many tasks by (population class, hash), every pair of its tiles that
can hold a link being compared. Only a spanning set of links leaves a tile.

For a similarity of the sets of shingles (a share of 0.8 of five-word shingles), fingerprints of
several words over the distinct shingles only find candidates. No covering of bit blocks stays
selective there, so rows are filed under bands of least hashes; their number sets the share of pairs
that is met. The radius lies well above the distance expected at the threshold, and a candidate pair
is linked only where the share of the two sets' shingles, counted exactly, reaches it. Documents whose
shingles are for the most part their own cannot reach it with any other and fall away first. A spanning
forest of the remaining candidates is counted, then every candidate between different components, so no
pair is left uncounted that could join two groups. doc_ids have to be unique and not null there.

Edge cases: null text is empty text; text without words has fingerprint zero and is linked
like any other; fewer words than ``width`` make one shingle; repeated rows link through their
equal fingerprint; a null doc_id gets a fingerprint, and the component of its group's other ids;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incrementa.llm.common import components, numpy_components, prepare, settle, slices, text_views

SEED = 42
TILE = 2048
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(body: bytes, width: int) -> list[int]:
    """XXH64 of every run of ``width`` words of lower-cased bytes; a shorter text is one shingle."""
    words = body.lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(b" ".join(words), SEED)]
    return [h(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(width)))]


class Scheme(NamedTuple):
    """How texts are printed and met: shingle width, 64-bit words a fingerprint, radius in bits, tables of (word, mask)."""

    width: int
    words: int
    radius: int
    tables: tuple[tuple[int, int], ...]
    similarity: float = 0.0  # of the sets, above 0 only where links are counted exactly
    bands: int = 0
    band_rows: int = 0
    reach: tuple[int, ...] = ()  # radius by the lesser number of shingles, the last for all larger ones

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.words)]

    @property
    def extra(self) -> list[str]:
        """Band keys and the number of distinct shingles, where links are counted exactly."""
        return [*(f"b{k}" for k in range(self.bands)), "m"] if self.similarity else []


def exact_scheme(width: int = 3, radius: int = 3) -> Scheme:
    """One word; every pair of ``radius + 2`` bit blocks is a table, so no pair within the radius is missed."""
    blocks = radius + 2
    edges = [round(64 * b / blocks) for b in range(blocks + 1)]
    span = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(blocks)]
    return Scheme(width, 1, radius, tuple((0, span[a] | span[b]) for a, b in combinations(range(blocks), 2)))


def bit_difference(shared: int, left: int, right: int) -> float:
    """Chance that a bit differs between the prints of two sets with so many shared shingles and others on either side."""
    few = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2**n
    at = lambda n: few(n)[None, :] * (2 * (np.arange(shared + 1)[:, None] + np.arange(n + 1)) > shared + n)
    a, b = at(left).sum(1), at(right).sum(1)
    return float((few(shared) * (a * (1 - b) + b * (1 - a))).sum())


def similar_scheme(width: int = 5, similarity: float = 0.8, words: int = 5, bands: int = 16, band_rows: int = 4) -> Scheme:
    """Candidates for sets with Jaccard ``similarity`` or more, which are then counted exactly.

    A band agrees with probability similarity ** band_rows, 0.41 at 0.8 and four rows: sixteen bands
    meet 0.9998 of the pairs right at the threshold. The radius is four standard deviations above
    the mean distance at the threshold, of sets of that size or larger (ties widen it for small ones).
    """
    n, limit, apart = 64 * words, math.acos(2 * similarity / (1 + similarity)) / math.pi, []
    for shared in range(1, 41):
        other = int(shared / similarity - shared + 1e-9)
        apart.append(max(bit_difference(shared, u, v) for u in range(other + 1) for v in range(u, other + 1 - u)))
    reach = []
    for size in range(51):
        mean = max([limit, *apart[max(0, math.ceil(similarity * size - 1e-9) - 1) :]])
        reach.append(math.ceil(n * mean + 4 * math.sqrt(n * mean * (1 - mean))))
    return Scheme(width, words, max(reach), (), similarity, bands, band_rows, tuple(reach))


def vote(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each of ``n`` documents: bits set in over half of its hashes."""
    planes = hashes.view(np.uint8).reshape(-1, 8)
    cell = (doc[:, None] * 2048 + np.arange(0, 2048, 256)[None, :] + planes).ravel()
    ones = (np.bincount(cell, minlength=n * 2048).reshape(n, 8, 256) @ _BITS).reshape(n, 64)
    total = np.bincount(doc, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def rehashed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes themselves for ``k`` 0, else a mix that is independent of them."""
    if not k:
        return hashes
    h = (hashes + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def band_keys(hashes: np.ndarray, count: np.ndarray, scheme: Scheme) -> list[np.ndarray]:
    """For every band, one key of each document: its least hashes under ``band_rows`` mixes; 0 for an empty set."""
    full = count > 0
    at = (np.cumsum(count) - count)[full]
    out = []
    for k in range(scheme.bands):
        key = np.zeros(len(count), np.uint64)
        for r in range(scheme.band_rows if len(at) else 0):
            least = np.minimum.reduceat(rehashed(hashes, 16 + k * scheme.band_rows + r), at)
            key[full] = rehashed(key[full] + least, 1)
        out.append(key.view(np.int64))
    return out


def fingerprint_batches(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            body, off = text_views(batch.column("text"))
            raw, hashes, count = body.tobytes(), [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                found = shingle_hashes(raw[a:b], scheme.width)
                if scheme.similarity:
                    found = list(dict.fromkeys(found))
                hashes += found
                count.append(len(found))
            h, doc = np.array(hashes, np.uint64), np.repeat(np.arange(len(count)), count)
            made = [vote(rehashed(h, k), doc, len(count)).view(np.int64) for k in range(scheme.words)]
            if scheme.similarity:
                made += [*band_keys(h, np.array(count), scheme), np.array(count, np.int64)]
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, made)], ["doc_id", *scheme.columns, *scheme.extra])


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, f0, ...) for every row; the fingerprint's bits as signed longs."""
    prepare(docs.sparkSession)
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in [*scheme.columns, *scheme.extra])])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: fingerprint_batches(it, scheme), schema)


def set_batches(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            body, off = text_views(batch.column("text"))
            raw = body.tobytes()
            sets = [np.unique(np.array(shingle_hashes(raw[a:b], scheme.width), np.uint64)).view(np.int64) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.record_batch([batch.column("doc_id"), lists], ["node", "shingles"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, shingles) of the rows whose doc_id is a ``wanted(node)``, equal rows once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(wanted.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return settle(rows.mapInArrow(lambda it: set_batches(it, scheme), "node long, shingles array<long>"), "sets")


def able(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, s) of the ``sets`` that can reach Jaccard ``similarity`` with another of them; s: shingles that another holds too.

    What two sets share is at most the lesser s, which settles most nodes without a pair being made:
    shared passages make many candidates, whose other shingles stand nowhere else.
    """
    for _ in range(2):  # those that fall away take shingles with them
        held = sets.select("node", F.explode("shingles").alias("h"))
        alone = held.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
        s = F.size("shingles") - F.coalesce("own", F.lit(0))
        found = sets.join(alone, "node", "left").withColumn("s", s.cast("long")).where(F.col("s") >= similarity * F.size("shingles") - 1e-9)
        sets = settle(found.drop("own"), "able")
        sets, found = sets.drop("s"), sets
    return found


def counted(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets of shingles have Jaccard ``similarity`` or more."""
    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    # common >= similarity * (x + y - common)
    enough = F.size(F.array_intersect("x", "y")) * (1 + similarity) >= similarity * (F.size("x") + F.size("y")) - 1e-9
    return settle(pairs.join(x, "a").join(y, "b").where(enough).select("a", "b"), "counted")


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ, over the last axis of words."""
    out = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for k in range(1, x.shape[-1]):
        out += np.bitwise_count(x[..., k] ^ y[..., k])
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i into x, j into y) of all pairs of fingerprints (rows of words) within ``radius``; tiles apart in population count are skipped."""
    px, py = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
    ox, oy = np.argsort(px, kind="stable"), np.argsort(py, kind="stable")
    x, y, px, py = x[ox], y[oy], px[ox], py[oy]
    step, left, right = 512, [], []
    for i in range(0, len(x), step):
        for j in range(0, len(y), step):
            if py[j] > px[min(i + step, len(x)) - 1] + radius or py[min(j + step, len(y)) - 1] < px[i] - radius:
                continue
            a, b = np.nonzero(distance(x[i : i + step, None], y[None, j : j + step]) <= radius)
            left.append(ox[a + i])
            right.append(oy[b + j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def spanning(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a spanning forest of the pairs (i, j) of ``n`` nodes, of least distances ``d``."""
    order = np.argsort(d, kind="stable")
    i, j, label, live, taken = i[order], j[order], np.arange(n), np.arange(len(i)), [np.zeros(0, np.int64)]
    while len(live := live[label[i[live]] != label[j[live]]]):
        best = np.full(n, len(i))
        np.minimum.at(best, label[i[live]], live)
        np.minimum.at(best, label[j[live]], live)
        pick = np.unique(best[best < len(i)])
        taken.append(pick)
        label = numpy_components(n, label[i[pick]], label[j[pick]])[label]
    t = np.concatenate(taken)
    return i[t], j[t]


def tile_links(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by tile (t, k, p, q); yields a spanning set of links (a, b) between nodes.

    Where links are counted exactly, these are candidates: a spanning forest of them, or all
    between different components where the rows have a ``root``.
    """
    held: list[pa.RecordBatch] = []
    radius = scheme.radius

    def solve(table: pa.Table) -> pa.RecordBatch:
        t, k, p, q, side, node = (table.column(c).to_numpy() for c in ("t", "k", "p", "q", "side", "node"))
        fp, n = np.stack([table.column(c).to_numpy().view(np.uint64) for c in scheme.columns], 1), len(t)
        new = np.ones(n, bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        group = np.cumsum(new) - 1
        i_all, j_all = [], []
        small = size <= 32
        for lag in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & small[group[lag:]])
            hit = distance(fp[i], fp[i + lag]) <= radius
            i_all.append(i[hit])
            j_all.append(i[hit] + lag)
        for a, m in zip(at[~small].tolist(), size[~small].tolist()):
            rows = np.arange(a, a + m)
            first = rows[side[rows] != 1]
            second = rows[side[rows] != 0]
            for u in range(0, len(first), TILE):
                for v in range(0, len(second), TILE):
                    i, j = close_pairs(fp[first[u : u + TILE]], fp[second[v : v + TILE]], radius)
                    i_all.append(first[u + i])
                    j_all.append(second[v + j])
        i = np.concatenate(i_all) if i_all else np.zeros(0, np.int64)
        j = np.concatenate(j_all) if j_all else np.zeros(0, np.int64)
        if scheme.similarity:
            m = table.column("m").to_numpy()
            # shared with others, where that is known: what two sets share is at most the lesser
            most = table.column("s").to_numpy() if "s" in table.column_names else m
            least = np.minimum(most[i], most[j])
            fit = (least * (1 + scheme.similarity) >= scheme.similarity * (m[i] + m[j]) - 1e-9) & (node[i] != node[j])
            fit &= (i < j) | (side[i] != side[j])  # a tile that meets itself tells of each pair twice
            fit &= distance(fp[i], fp[j]) <= np.array(scheme.reach)[np.minimum(np.minimum(m[i], m[j]), len(scheme.reach) - 1)]
            if rooted := "root" in table.column_names:
                root = table.column("root").to_numpy()
                fit &= root[i] != root[j]
            i, j = i[fit], j[fit]
            if rooted and len(i):  # a pair is told of in the first band that both share
                bands = np.stack([table.column(f"b{b}").to_numpy() for b in range(scheme.bands)], 1)
                some = range(0, len(i), 100_000)
                first = np.concatenate([(bands[i[a : a + 100_000]] == bands[j[a : a + 100_000]]).argmax(axis=1) for a in some]) == t[i]
                i, j = i[first], j[first]
            if not rooted:
                i, j = spanning(n, i, j, distance(fp[i], fp[j]))
            return pa.record_batch([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["a", "b"])
        root = numpy_components(n, i, j)
        far = np.flatnonzero(root != np.arange(n))
        return pa.record_batch([pa.array(node[far]), pa.array(node[root[far]])], ["a", "b"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 200_000:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(c).to_numpy() for c in ("t", "k", "p", "q")]
        differs = np.zeros(table.num_rows, bool)
        for x in keys:
            differs |= x != x[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield solve(table.slice(0, cut))
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield solve(pa.Table.from_batches(held))


def links(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Spanning links (a, b) among ``nodes(f0, ..., node)`` that share a bucket and differ in at most the radius.

    Where links are counted exactly, their candidates: see :func:`tile_links`.
    """
    cols = scheme.columns
    held = [*cols, *(c for c in ("m", "s", "root") if c in nodes.columns), "node"]
    held += [f"b{k}" for k in range(scheme.bands)] if "root" in held else []
    signed = [(w, m - (1 << 64) if m >> 63 else m) for w, m in scheme.tables]
    keys = [F.col(cols[w]).bitwiseAND(F.lit(m)) for w, m in signed] or [F.col(f"b{k}") for k in range(scheme.bands)]
    filed = nodes.select(*held, F.explode(F.array(*(F.struct(F.lit(t).alias("t"), k.alias("k")) for t, k in enumerate(keys)))).alias("x")).select("x.t", "x.k", *held)
    size = settle(filed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    kept = filed.join(size, ["t", "k"])
    # tile of a row in a large bucket: (population class of radius + 1 counts, hash); a class meets itself and its neighbours
    parts = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    cls = F.floor(sum((F.bit_count(c) for c in cols), F.lit(0)) / F.lit(scheme.radius + 1)).cast("int")
    own = cls * parts + F.pmod(F.xxhash64(*cols), parts).cast("int")
    lone = kept.where(F.col("n") <= TILE).select("t", "k", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("side"), *held)
    met = kept.where(F.col("n") > TILE).select("t", "k", *held, own.alias("own"), F.explode(F.sequence(F.greatest(F.lit(0), (cls - 1) * parts), (cls + 2) * parts - 1)).alias("other"))
    met = met.select("t", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), *held)
    tiles = lone.unionByName(met).repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q")
    return tiles.mapInArrow(lambda it: tile_links(it, scheme), "a long, b long")


def similar_links(nodes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) that join all ``nodes`` connected by candidate pairs of the scheme's similarity."""
    first = settle(links(nodes, scheme).distinct(), "candidates")
    wanted = settle(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = able(shingle_sets(docs, wanted, scheme), scheme.similarity)
    nodes = settle(nodes.join(sets.select("node", "s"), "node"), "able-nodes")
    first = settle(links(nodes, scheme).distinct(), "first")
    sure = counted(first, sets, scheme.similarity)
    labelled = settle(nodes.join(components(sure), "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    rest = settle(links(labelled, scheme).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    return sure.unionByName(counted(rest, sets, scheme.similarity))


def near_groups(prints: DataFrame, scheme: Scheme, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, f0, ..., component_id) for every row of settled ``prints(doc_id, f0, ...)``; ``docs`` are asked where links are counted exactly."""
    cols = [*scheme.columns, *scheme.extra]
    nodes = settle(prints.groupBy(*cols).agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    roots = components(similar_links(nodes, docs, scheme) if scheme.similarity else links(nodes, scheme))
    named = settle(nodes.join(roots, "node", "left").select(*cols, F.coalesce("root", "node").alias("component_id")), "named")
    return prints.join(named, cols, "left").select("doc_id", *scheme.columns, "component_id")


def simhash_groups(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits a word), component_id (smallest doc_id reachable)."""
    scheme = scheme or exact_scheme()
    prints = settle(fingerprints(docs, scheme), "prints")
    digits = F.concat(*(F.lower(F.lpad(F.hex(c), 16, "0")) for c in scheme.columns))
    return near_groups(prints, scheme, docs).select("doc_id", digits.alias("fingerprint"), "component_id")
