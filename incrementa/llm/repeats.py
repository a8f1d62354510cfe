"""Repeated 50-byte strings across documents, by suffix arrays within shards and merging between them.

1. Documents go to shards by a hash of the row. Each 50-byte window has an anchor, the least hash of
   the 28-byte strings in it; equal windows have equal anchors. A shard's distinct anchors are sorted.
2. Anchors of all shards are merged bucket by bucket; binary search in the merged list tells every
   shard which of its anchors occur in a second document. Only windows with such an anchor can repeat.
3. Each shard builds the suffix array of its text in those windows by Larsson and Sadakane's refinement,
   fifty bytes deep, and Kasai's common prefixes of neighbours in it. Equal windows are neighbours with
   fifty bytes in common; the least doc_id of the shard keeps them, larger ones lose them.
4. What is left goes to the bucket of its anchor, as text and the windows' suffix order. There the shards'
   sorted windows are merged two by two by binary search, and larger doc_ids lose what a smaller one holds.
5. A shard gets its spans back, joins them and drops their bytes.

Comparison is by the bytes themselves; hashes only say where to look. A passage held by any share of
all documents is sent once a shard, not once a document.

Edge cases: null text is empty; texts under 50 bytes lose nothing; repeats within one document stay;
rows with the same doc_id take nothing from each other; rows with a null doc_id neither lose nor take;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incrementa.llm.common import discard, prepare, settle, text_views

LENGTH, GRAM = 50, 28
SHARD_BYTES = 4 << 20
#: windows that are sorted together before lists are merged; affects time only
FEW = 4096
_T = np.random.default_rng(91).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = (np.random.default_rng(92).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_ONE = np.uint64(1)
#: a shard's message to a bucket, see ``message``
SENT = ["bucket", "shard", "x0", "x1", "x2", "x3", "x4", "x5"]


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place, low bit clear."""
    h = _T[body]
    by = {1: h}
    for k, m in enumerate((1, 2, 4, 8)):
        h = h[:-m] * np.uint64(_C[k]) + h[m:]
        by[2 * m] = h
    n = len(body) - GRAM + 1
    h = by[16][:n] * np.uint64(_C[5]) + by[8][16 : 16 + n] * np.uint64(_C[7]) + by[4][24 : 24 + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(_C[6])
    h ^= h >> np.uint64(32)
    return h & ~_ONE


def window_anchors(body: np.ndarray) -> np.ndarray:
    """Anchor of the window at every place of one or several texts laid end to end."""
    if len(body) < LENGTH:
        return np.zeros(0, np.uint64)
    m = gram_hashes(body)
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    width = LENGTH - GRAM + 1
    return np.minimum(m[: len(body) - LENGTH + 1], m[width - 16 : width - 16 + len(body) - LENGTH + 1])  # 16 <= width <= 32


def runs(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window, windows) of the maximal runs of a document's windows with one anchor."""
    v = window_anchors(body)
    n = len(v)
    doc_of_start = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    valid = np.arange(n) + LENGTH <= off[1:][doc_of_start] if n else np.zeros(0, bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (v[1:] != v[:-1]) | (doc_of_start[1:] != doc_of_start[:-1])
    at = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    # least hashes are small; an odd factor spreads them evenly over the buckets
    return v[at] * np.uint64(_C[0]), doc_of_start[at], at, np.flatnonzero(stop) - at + 1


def shard_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, which are not null, bytes, offsets) of a shard's documents in a fixed order, whatever order they came in."""
    table = table.select(["doc_id", "text"])
    order = sorted(range(table.num_rows), key=lambda i: ((d := table.column("doc_id")[i].as_py()) is None, d or 0, table.column("text")[i].as_py() or ""))
    table = table.take(pa.array(order, pa.int64()))
    body, off = text_views(table.column("text"))
    ids = table.column("doc_id").to_pylist()
    return np.array([0 if d is None else d for d in ids], np.int64), np.array([d is not None for d in ids], bool), body, off


def anchor_table(table: pa.Table, bits: int) -> pa.Table:
    """A shard's distinct anchors by bucket, sorted; low bit: it is in two documents of the shard."""
    shard = table.column("shard")[0].as_py()
    ids, known, body, off = shard_of(table)
    v, doc, _, _ = runs(body, off)
    v, doc = v[known[doc]], doc[known[doc]]
    order = np.argsort(v, kind="stable")
    v, who = v[order], ids[doc[order]]
    first = np.ones(len(v), bool)
    first[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(first)
    several = np.zeros(len(at), np.uint64)
    if len(at):
        several = (np.maximum.reduceat(who, at) != np.minimum.reduceat(who, at)).astype(np.uint64)
    key = v[at] | several
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    return by_bucket(bucket, [key], shard)


def by_bucket(bucket: np.ndarray, arrays: list[np.ndarray], shard: int) -> pa.Table:
    """One row for each bucket in sorted ``bucket``, with its part of the arrays as bytes."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(bucket)) if len(at) else at
    columns = [pa.array(bucket[at], pa.int64()), pa.array([shard] * len(at), pa.int64())]
    columns += [pa.array([x[a:b].tobytes() for a, b in zip(at.tolist(), end.tolist())], pa.binary()) for x in arrays]
    return pa.table(columns, names=["bucket", "shard", *(f"x{k}" for k in range(len(arrays)))])


def merge_bucket(table: pa.Table) -> pa.Table:
    """For each shard, its anchors of this bucket that occur in a second document anywhere."""
    parts = [np.frombuffer(x, "<u8") for x in table.column("x0").to_pylist()]
    every = np.sort(np.concatenate(parts))
    plain = every & ~_ONE
    again = np.zeros(len(every), bool)
    again[1:] = plain[1:] == plain[:-1]
    common = np.unique(plain[again | (every & _ONE).astype(bool)])
    out = []
    for p in parts:
        p = p & ~_ONE
        k = np.searchsorted(common, p)
        out.append(p[(k < len(common)) & (common[np.minimum(k, len(common) - 1)] == p)] if len(common) else p[:0])
    full = [i for i, p in enumerate(out) if len(p)]
    return pa.table([pa.array([table.column("shard")[i].as_py() for i in full], pa.int64()), pa.array([out[i].tobytes() for i in full], pa.binary())], names=["shard", "keys"])


def big_endian(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as a number that sorts as they do; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(text), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def suffix_order(text: np.ndarray, start: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``start`` (ascending) in the order of the LENGTH bytes there, equal ones by place: a suffix array as deep as is asked.

    Larsson and Sadakane's refinement: suffixes are ranked by eight bytes, then groups that are not single yet are
    sorted by the ranks of what follows the bytes compared so far, which doubles the depth. The last round
    takes the ranks 18 places on, as 32 + 18 are LENGTH.
    """
    n = len(text)
    order = np.argsort(words)
    key = words[order]
    first = np.append(True, key[1:] != key[:-1])
    rank = np.zeros(n + LENGTH, np.int64)
    number = np.flatnonzero(first)
    rank[order] = np.repeat(number, np.diff(np.append(number, n))) + 1
    for depth in (8, 16):
        single = first & np.append(first[1:], True)
        slot = np.flatnonzero(~single)
        at = order[slot]
        key = (rank[at] << 32) | rank[at + depth]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slot] = at
        split = np.append(True, key[1:] != key[:-1])[: len(key)]
        first[slot] = split
        number = np.flatnonzero(split)
        rank[at] = np.repeat(slot[number], np.diff(np.append(number, len(at)))) + 1
    wanted = np.zeros(n, bool)
    wanted[start] = True
    order = order[wanted[order]]
    key = (rank[order] << 32) | rank[order + LENGTH - 32]
    top = key >> 32
    single = np.append(True, top[1:] != top[:-1]) & np.append(top[1:] != top[:-1], True)
    slot = np.flatnonzero(~single)
    at, key = order[slot], key[slot]
    by = np.argsort(key)
    key, at = key[by], at[by]
    number = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)])
    order[slot] = np.sort((number << 32) | at) & 0xFFFFFFFF
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in ``order`` and the one before it, exact below LENGTH.

    Kasai's scan: where the neighbour of the next place is the next place of the neighbour, the prefix is one byte
    shorter, so along such a chain one comparison a byte tells all; only chain ends are compared on their own.
    """
    n = len(text)
    before = np.full(n + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before[:n] >= 0)
    other = before[at]
    chained = before[at + 1] == other + 1
    stop = np.where(text[at] != text[other], at, -1)
    ends = np.flatnonzero(~chained & (stop < 0))
    p, q = at[ends], other[ends]
    length = np.zeros(len(ends), np.int64)
    going = np.arange(len(ends))
    for depth in range(0, LENGTH, 8):
        i, j = p[going] + depth, q[going] + depth
        inside = np.maximum(i, j) < n
        x = np.where(inside, words[np.minimum(i, n - 1)] ^ words[np.minimum(j, n - 1)], np.uint64(1) << np.uint64(63))
        zeros = np.zeros(len(x), np.int64)
        for k in range(8):
            zeros += x < (np.uint64(1) << np.uint64(56 - 8 * k)) if k < 7 else x == 0
        length[going] += zeros
        going = going[x == 0]
    stop[ends] = p + length
    known = np.where(stop >= 0, np.arange(len(at)), len(at))
    following = np.minimum.accumulate(known[::-1])[::-1]
    prefix = np.zeros(n, np.int64)
    prefix[at] = stop[following] - at
    return prefix[order]


def spread(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """at, at + 1, ... for ``count`` places each, end to end."""
    return np.arange(int(count.sum())) + np.repeat(at - (np.cumsum(count) - count), count)


def stretches(place: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of the maximal stretches of consecutive ascending places with one ``of``."""
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (np.diff(place) != 1) | (of[1:] != of[:-1]))
    return np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))


def bounds(sorted_key: np.ndarray) -> tuple[list[int], list[int]]:
    """Begin and end of each stretch of equal values (none negative)."""
    at = np.flatnonzero(np.diff(sorted_key, prepend=-1)) if len(sorted_key) else np.zeros(0, np.int64)
    return at.tolist(), (np.append(at[1:], len(sorted_key)) if len(at) else at).tolist()


def candidates(docs: pa.Table, keys: pa.Table, bits: int) -> pa.Table:
    """A shard's windows with a common anchor, by bucket, as runs of bytes and the windows' suffix order.

    The shard's suffix array over them tells equal ones; those that a smaller doc_id of the shard holds too are
    lost here, and told of in a bucket of the shard's own, below zero.
    """
    none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 6)], names=SENT)
    if not docs.num_rows or not keys.num_rows:
        return none
    shard = docs.column("shard")[0].as_py()
    ids, known, body, off = shard_of(docs)
    v, doc, at, n = runs(body, off)
    common = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in keys.column("keys").to_pylist()]))
    k = np.searchsorted(common, v)
    hit = (common[np.minimum(k, len(common) - 1)] == v) & known[doc]
    v, doc, at, n = v[hit], doc[hit], at[hit], n[hit]
    if not len(v):
        return none
    level = np.zeros(len(body) + 1, np.int8)
    level[at] += 1
    cover = np.cumsum(level_ends(level, at + n + LENGTH - 1)[:-1], dtype=np.int32) > 0
    text = body[cover]
    moved = np.cumsum(cover, dtype=np.int64) - 1
    start, run = spread(at, n), np.repeat(np.arange(len(at)), n)
    here = moved[start]
    words = big_endian(text)
    order = suffix_order(text, here, words)
    same = common_prefixes(text, order, words) >= LENGTH
    index = np.zeros(len(text), np.int64)
    index[here] = np.arange(len(here))
    order = index[order]
    who = ids[doc[run]]
    first = np.flatnonzero(~same)
    lost = np.zeros(len(start), bool)
    lost[order] = who[order] > np.repeat(who[order[first]], np.diff(np.append(first, len(order))))
    gone = np.flatnonzero(lost)
    a, b = stretches(start[gone], doc[run[gone]])
    a, b = gone[a], gone[b]
    base = off[doc[run[a]]]
    spans = np.stack([doc[run[a]], start[a] - base, start[b] - base + LENGTH], 1).astype("<i4")
    # what is left goes to the buckets: runs in text order, and their windows' numbers in suffix order
    lead = np.flatnonzero(~lost)
    a, b = stretches(start[lead], run[lead])
    a, b = lead[a], lead[b]
    wide = np.uint16 if bits <= 16 else np.int64
    bucket = ((v >> np.uint64(64 - bits)) if bits else v * np.uint64(0)).astype(wide)
    by = np.argsort(bucket[run[a]], kind="stable")
    a, b = a[by], b[by]
    heads = (who[a], doc[run[a]], start[a] - off[doc[run[a]]], b - a + LENGTH)
    number = np.zeros(len(start), np.int64)
    number[spread(a, b - a + 1)] = np.arange(len(lead))
    order = order[~lost[order]]
    order = order[np.argsort(bucket[run[order]], kind="stable")]
    ordered = number[order]
    raw = memoryview(body)
    cut, end = bounds(bucket[run[a]].astype(np.int64))
    wcut, wend = bounds(bucket[run[order]].astype(np.int64))
    froms, tos = start[a].tolist(), (start[b] + LENGTH).tolist()
    rows = [
        (int(bucket[run[a[i]]]), *message(*(x[i:j] for x in heads), b"".join([raw[x:y] for x, y in zip(froms[i:j], tos[i:j])]), ordered[p:q] - p))
        for i, j, p, q in zip(cut, end, wcut, wend)
    ]
    if len(spans):
        rows.append((-1 - shard, spans.tobytes(), *[b""] * 5))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 7))], names=SENT)


def level_ends(level: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``level`` less one at each of the distinct ``ends``."""
    level[ends] -= 1
    return level


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed: what is small or alike takes little."""
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def message(who: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, text: bytes, order: np.ndarray) -> tuple[bytes, ...]:
    """Runs of one shard for one bucket: doc_id (as steps), document in the shard, place in it and bytes of each; text; the windows' suffix order."""
    heads = [packed(np.diff(x, prepend=0).astype(k)) for x, k in ((who, "<i8"), (doc, "<i4"))] + [packed(x.astype("<i4")) for x in (place, size)]
    return (*heads, zstandard.compress(text, 1), packed(order.astype("<u4")))


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted lists of distinct windows with their least doc_ids as one, and the new places of either's members."""
    (ka, wa), (kb, wb) = a, b
    at = np.searchsorted(ka, kb)
    equal = ka[np.minimum(at, len(ka) - 1)] == kb
    fresh = np.flatnonzero(~equal)
    to_a = np.arange(len(ka)) + np.searchsorted(at[fresh], np.arange(len(ka)), side="right")
    to_b = np.empty(len(kb), np.int64)
    to_b[fresh] = at[fresh] + np.arange(len(fresh))
    to_b[equal] = to_a[at[equal]]
    key = np.empty(len(ka) + len(fresh), ka.dtype)
    who = np.empty(len(key), np.int64)
    key[to_a], who[to_a] = ka, wa
    key[to_b[fresh]], who[to_b[fresh]] = kb[fresh], wb[fresh]
    both = to_b[equal]
    who[both] = np.minimum(who[both], wb[equal])
    return key, who, to_a, to_b


def least_owners(lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least doc_id of every window of sorted lists (windows, doc_ids), laid end to end; lists are merged two by two by binary search.

    Lists of few windows are first sorted together, so that thousands of them take no thousands of steps.
    """
    level, places, held = [], [], []
    for i, one in enumerate(lists):
        held.append(one)
        if sum(len(k) for k, _ in held) < FEW and i + 1 < len(lists):
            continue
        key, who = (np.concatenate([x[c] for x in held]) for c in (0, 1))
        by = np.argsort(key, kind="stable") if len(held) > 1 else np.arange(len(key))
        new = np.append(True, key[by[1:]] != key[by[:-1]])
        first = np.flatnonzero(new)
        level.append((key[by[first]], np.minimum.reduceat(who[by], first), len(places)))
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(new) - 1
        places.append([place])
        held = []
    trees = [(key, who, [k]) for key, who, k in level]
    while len(trees) > 1:
        above = []
        for a, b in zip(trees[::2], trees[1::2]):
            key, who, to_a, to_b = merged(a[:2], b[:2])
            for tree, to in ((a, to_a), (b, to_b)):
                for k in tree[2]:
                    places[k][0] = to[places[k][0]]
            above.append((key, who, a[2] + b[2]))
        trees = above + trees[len(trees) // 2 * 2 :]
    who = trees[0][1]
    return np.concatenate([who[p[0]] for p in places])


def lost_in_bucket(table: pa.Table) -> pa.Table:
    """Spans that documents of each shard lose, judged over all windows of this bucket."""
    names, kinds = ["shard", "spans"], (pa.int64(), pa.binary())
    if (own := table.column("bucket")[0].as_py()) < 0:
        return pa.table([pa.array([-1 - own], kinds[0]), table.column("x0").combine_chunks()], names=names)
    rows = sorted(zip(*(table.column(c).to_pylist() for c in SENT[1:])))
    lists, told = [], []
    for shard, *heads, text, ordered in rows:
        who, doc, place, size = (unpacked(x, k) for x, k in zip(heads, ("<i8", "<i4", "<i4", "<i4")))
        who, doc = np.cumsum(who), np.cumsum(doc)
        raw = np.frombuffer(zstandard.decompress(text), np.uint8)
        count = size - LENGTH + 1
        start = spread(np.cumsum(size) - size, count)
        order = unpacked(ordered, "<u4")
        windows = np.lib.stride_tricks.as_strided(raw, (len(raw) - LENGTH + 1, LENGTH), (1, 1))
        key = windows[start[order]].view(f"S{LENGTH}").ravel()  # both sides have LENGTH bytes, so no zero at the end is lost
        run = np.repeat(np.arange(len(size)), count)
        lists.append((key, who[run[order]]))
        told.append((shard, doc, place, run, order, count))
    least = least_owners(lists)
    out: list[tuple[int, bytes]] = []
    done = 0
    for (shard, doc, place, run, order, count), (_, who) in zip(told, lists):
        bad = np.zeros(len(run), bool)
        bad[order] = who > least[done : done + len(order)]
        done += len(order)
        if not bad.any():
            continue
        inside = spread(np.zeros(len(count), np.int64), count)
        gone = np.flatnonzero(bad)
        a, b = stretches(inside[gone], run[gone])
        a, b = gone[a], gone[b]
        at = place[run[a]]
        out.append((shard, np.stack([doc[run[a]], at + inside[a], at + inside[b] + LENGTH], 1).astype("<i4").tobytes()))
    return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)


def cleaned(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of a shard's documents."""
    none = np.zeros(0, np.int64)
    ids, known, body, off = shard_of(docs) if docs.num_rows else (none, none.astype(bool), np.zeros(0, np.uint8), np.zeros(1, np.int64))
    parts = [np.frombuffer(x, "<i4").reshape(-1, 3) for x in spans.column("spans").to_pylist()]
    lost = np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, 3), np.int64)
    level = np.zeros(len(body) + 1, np.int32)
    np.add.at(level, off[lost[:, 0]] + lost[:, 1], 1)
    np.add.at(level, off[lost[:, 0]] + lost[:, 2], -1)
    gone = np.cumsum(level[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edge = off[:-1][off[:-1] < len(body)]
    begins[edge] = gone[edge]
    count = np.concatenate([[0], np.cumsum(gone)])
    spans_before = np.concatenate([[0], np.cumsum(begins)])
    kept = [body[a:b][~gone[a:b]].tobytes() if count[b] > count[a] else body[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return pa.table(
        [pa.array(ids, pa.int64(), mask=~known), pa.array(np.diff(off)), pa.array(np.diff(count[off])), pa.array(np.diff(spans_before[off])), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def release(df: DataFrame) -> DataFrame:
    """Lets Spark's cleaner drop the shuffle files of what has been written; it acts on collected references, those of Python first."""
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    return df


def without_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    bits = (2 * int(total) // shard_bytes).bit_length()
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    wide = "bucket long, shard long, x0 binary"
    anchors = release(settle(docs.groupBy("shard").applyInArrow(lambda t: anchor_table(t, bits), wide), "anchors", "none"))
    keys = release(settle(anchors.groupBy("bucket").applyInArrow(merge_bucket, "shard long, keys binary"), "keys", "none"))
    discard(anchors)
    sent = "bucket long, shard long, " + ", ".join(f"{x} binary" for x in SENT[2:])
    found = docs.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(lambda d, k: candidates(d, k, bits), sent)
    spans = release(settle(found.groupBy("bucket").applyInArrow(lost_in_bucket, "shard long, spans binary"), "spans"))
    discard(keys)
    return docs.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
