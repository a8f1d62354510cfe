"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits. Fixed masks over a few successive tokens ignore
some positions, so that a substituted token spoils only the seeds that look at it. Seeds of documents
are joined with those of the benchmark: where the benchmark's text is at most ``block_bytes``, its
seeds are a sorted table in every worker; beyond that, documents' seeds that pass a bitmap of the
benchmark's are joined with them by hash in a shuffle, and the tokens of either side are cut out around
the hit. Both ways find the same. Around every hit, document and item are laid side by
side on the hit's diagonal and their tokens compared; a document is contaminated where a window of
``window`` tokens, or of all of a shorter item's, agrees in at least ``share`` of its places. At a
window of 13 and a share of 0.8, every pattern of substitutions that this allows keeps a seed.

Edge cases: null or empty text holds nothing; items of fewer than ``SHORTEST`` tokens never match
(single common words would flag everything), short items are matched whole or but for one token;
an item without an id takes part as any other, as null at the end of ``item_ids``; rows are judged each,
also those that repeat a doc_id or have none; empty tables give no contamination or no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incrementa.llm.common import prepare, settle, slices, text_views

#: fixed values: 1 looks at a token, 0 ignores it
MASKS = ("11111101", "11101111", "110110111", "1011011011", "11010001111", "1111001001001")
#: for items of ten to twelve tokens also, whose seeds have fewer places to stand
MORE_MASKS = ("1111111", "11111011", "1100111011", "1111100011", "1110001111", "1101011101", "1101010111", "1010110111")
SHORTEST = 5
#: items of so many tokens or fewer are also matched whole, and whole but for any one token
SHORT = 9
#: items of so many tokens or more have places enough for the seeds of ``MASKS`` alone
LONG = 13
#: bytes of benchmark text up to which its seeds (about 1.5 a byte at most) go to every task
BLOCK_BYTES = 4 << 20
#: places of pairs that are compared at once
PLACES = 1 << 20
#: upper bits of a seed that the bitmap of a larger benchmark looks at
BITMAP_BITS = 24
_STEP = np.random.default_rng(77).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = np.random.default_rng(78).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _letters() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for a, b in ((48, 58), (97, 123)):
        table[a:b] = np.arange(a, b)
    table[65:91] = np.arange(97, 123)
    return table


_LETTER = _letters()


def tokens(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text incl. the end); a token never spans two texts."""
    low = _LETTER[body]
    word = low > 0
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = off[:-1][off[:-1] < len(body)]
    begin[edge] = word[edge]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    place = np.arange(len(body)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(body)]])))
    h = np.add.reduceat(low.astype(np.uint64) * _STEP[place & 4095], at)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h, np.searchsorted(at, off)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's tokens at every place where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(len(mask) * 0x51ED27 + int(mask, 2)))
    for k, c in enumerate(mask):
        if c == "1":
            out += h[k : k + n] * _COEF[k]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Seeds(NamedTuple):
    """Sorted seed hashes of items, with item and place; and the items' tokens."""

    key: np.ndarray
    item: np.ndarray
    place: np.ndarray
    masks: tuple[str, ...]
    ids: list[int | None]
    token: np.ndarray
    first: np.ndarray
    near: np.ndarray  # 2^20 flags by the upper bits of a seed


def item_masks(n: int) -> list[str]:
    """Masks that an item of ``n`` tokens is seeded with."""
    if n < SHORTEST:
        return []
    own = [m for m in MASKS if len(m) <= n]
    if n <= SHORT:
        own += ["1" * n, *("1" * k + "0" + "1" * (n - k - 1) for k in range(n))]
    elif n < LONG:
        own += [m for m in MORE_MASKS if len(m) <= n]
    return own


def item_seeds(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, item, place) of the seeds of items whose tokens lie one after the other."""
    key, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(first) - 1):
        h = token[first[i] : first[i + 1]]
        for m in item_masks(len(h)):
            s = seed_hashes(h, m)
            key.append(s)
            item.append(np.full(len(s), i))
            place.append(np.arange(len(s)))
    return np.concatenate(key), np.concatenate(item), np.concatenate(place)


def all_masks(lengths: set[int]) -> tuple[str, ...]:
    """Masks that items of these numbers of tokens are seeded with."""
    return tuple(dict.fromkeys([*MASKS, *(m for n in sorted(lengths) for m in item_masks(n))])) if any(n >= SHORTEST for n in lengths) else ()


def make_seeds(ids: list[int | None], texts: list[str | None]) -> Seeds:
    raw = [(t or "").encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    token, first = tokens(np.frombuffer(b"".join(raw), np.uint8), off)
    key, item, place = item_seeds(token, first)
    order = np.argsort(key, kind="stable")
    near = np.zeros(1 << 20, bool)
    near[key >> np.uint64(44)] = True
    return Seeds(key[order], item[order], place[order], all_masks(set(np.diff(first).tolist())), ids, token, first, near)


def agreement(a: np.ndarray, b: np.ndarray, window: int, share: float) -> tuple[int, int] | None:
    """(start, matches) of the best window of ``window`` places in which the runs agree in at least ``share``; none otherwise."""
    w = window
    if len(a) < w:
        return None
    c = np.concatenate([[0], np.cumsum(a == b)])
    n = c[w:] - c[:-w]
    k = int(n.argmax())
    return (k, int(n[k])) if n[k] >= np.ceil(share * w) else None


def agreements(x: np.ndarray, y: np.ndarray, a: np.ndarray, q: np.ndarray, run: np.ndarray, w: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`agreement` for many pairs at once: runs of ``run`` places from ``a`` in x and ``q`` in y; (start, matches), start -1 where none agrees."""
    start, same = np.full(len(a), -1), np.zeros(len(a), np.int64)
    fit = np.flatnonzero((run >= w) & (w > 0))
    ends = np.cumsum(run[fit])
    cuts = np.searchsorted(ends, np.arange(PLACES, (ends[-1] if len(ends) else 0) + PLACES, PLACES))
    for some in np.split(fit, np.unique(cuts[cuts > 0])):
        if not len(some):
            continue
        n, at = run[some], np.cumsum(run[some]) - run[some]
        place = np.arange(n.sum())
        inside = place - np.repeat(at, n)
        c = np.concatenate([[0], np.cumsum(x[np.repeat(a[some], n) + inside] == y[np.repeat(q[some], n) + inside])])
        width = np.repeat(w[some], n)
        agree = np.where(inside + width <= np.repeat(n, n), c[np.minimum(place + width, len(place))] - c[place], -1)
        most = np.maximum.reduceat(agree, at)
        first = np.minimum.reduceat(np.where(agree == np.repeat(most, n), inside, len(place)), at)
        hit = most >= np.ceil(share * w[some])
        start[some[hit]], same[some[hit]] = first[hit], most[hit]
    return start, same


def matches(batches: Iterator[pa.RecordBatch], seeds: Seeds, window: int, share: float) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches, with what was found in them: arrays of document, item, first token, end, matches."""
    size = np.diff(seeds.first)
    for whole in batches:
        for batch in slices(whole, "text"):
            body, off = text_views(batch.column("text"))
            h, first = tokens(body, off)
            pairs = [np.zeros(0, np.int64)]
            # document, item and diagonal as one number: diagonals from -longest to the last token
            longest, items = int(size.max(initial=0)), max(len(size), 1)
            reach = int(np.diff(first).max(initial=0)) + longest + 1
            for mask in seeds.masks:
                s = seed_hashes(h, mask)
                at = np.flatnonzero(seeds.near[s >> np.uint64(44)])
                lo, hi = np.searchsorted(seeds.key, s[at], "left"), np.searchsorted(seeds.key, s[at], "right")
                at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                if len(at):
                    hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    doc = np.searchsorted(first, at, side="right") - 1
                    there = np.repeat(at - first[doc], n) - seeds.place[hit] + longest
                    pairs.append(np.unique((np.repeat(doc, n) * items + seeds.item[hit]) * reach + there))
            rest, at = np.divmod(np.unique(np.concatenate(pairs)), reach)
            doc, item = np.divmod(rest, items)
            at += first[doc] - longest
            a, b = np.maximum(at, first[doc]), np.minimum(at + size[item], first[doc + 1])
            w = np.minimum(window, size[item])
            start, same = agreements(h, seeds.token, a, seeds.first[item] + a - at, b - a, w, share)
            hit = start >= 0
            begin = (a - first[doc] + start)[hit]
            yield batch, [doc[hit], item[hit], begin, begin + w[hit], same[hit]]


def _order(found: tuple) -> tuple:
    return found[0] is None, found[0] or 0, *found[1:]


def _span(item: int | None, start: int, end: int, same: int) -> str:
    return f"{'null' if item is None else item}:{start}:{end}:{same}"


def match_batches(batches: Iterator[pa.RecordBatch], seeds: Seeds, window: int, share: float) -> Iterator[pa.RecordBatch]:
    """Rows of every document: found items (ids, sorted) and the spans that show them, in tokens."""
    for batch, found in matches(batches, seeds, window, share):
        each: list[set] = [set() for _ in range(batch.num_rows)]
        for doc, item, *where in zip(*(c.tolist() for c in found)):
            each[doc].add((seeds.ids[item], *where))
        rows = [sorted(f, key=_order) for f in each]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array([list(dict.fromkeys(x[0] for x in f)) for f in rows], pa.list_(pa.int64())), pa.array([[_span(*x) for x in f] for f in rows], pa.list_(pa.string()))],
            ["doc_id", "item_ids", "spans"],
        )


def clean_batches(batches: Iterator[pa.RecordBatch], seeds: Seeds, window: int, share: float) -> Iterator[pa.RecordBatch]:
    for batch, found in matches(batches, seeds, window, share):
        clean = np.ones(batch.num_rows, bool)
        clean[found[0]] = False
        yield batch.filter(pa.array(clean))


def item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered items with their tokens and their seeds."""
    part, seq = TaskContext.get().partitionId(), 0
    for whole in batches:
        for batch in slices(whole, "text"):
            token, first = tokens(*text_views(batch.column("text")))
            n, size = batch.num_rows, np.diff(first)
            key, item, place = item_seeds(token, first)
            cut = np.searchsorted(item, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (key.view(np.int64), place.astype(np.int32))]
            raw = [token[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.record_batch([pa.array((part << 40) + seq + np.arange(n)), batch.column("item_id"), pa.array(size.astype(np.int32)), pa.array(raw, pa.binary()), *lists], ["item", "item_id", "size", "token", "key", "place"])
            seq += n


def probe_batches(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...], near: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Numbered documents; those with seeds in the bitmap have them, their places and all tokens."""
    part, seq, shift = TaskContext.get().partitionId(), 0, np.uint64(64 - BITMAP_BITS)
    for whole in batches:
        for batch in slices(whole, "text"):
            h, first = tokens(*text_views(batch.column("text")))
            key, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            inside = np.repeat(first[1:], np.diff(first))
            for mask in masks:
                s = seed_hashes(h, mask)
                bit = s >> shift
                hit = np.flatnonzero((near[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool))
                hit = hit[hit + len(mask) <= inside[hit]]
                key.append(s[hit])
                at.append(hit)
            key, at = np.concatenate(key), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            key, at = key[order], at[order]
            n = batch.num_rows
            cut = np.searchsorted(at, first).astype(np.int32)
            place = at - np.repeat(first[:-1], np.diff(cut))
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (key.view(np.int64), place.astype(np.int32))]
            raw = [h[a:b].tobytes() if c > d else None for a, b, c, d in zip(first[:-1].tolist(), first[1:].tolist(), cut[1:].tolist(), cut[:-1].tolist())]
            yield pa.record_batch([pa.array((part << 40) + seq + np.arange(n)), batch.column("rid"), batch.column("doc_id"), pa.array(np.diff(first).astype(np.int32)), pa.array(raw, pa.binary()), *lists], ["doc", "rid", "doc_id", "n", "h", "key", "place"])
            seq += n


def verify_batches(batches: Iterator[pa.RecordBatch], window: int, share: float) -> Iterator[pa.RecordBatch]:
    """Pairs of token runs laid side by side: those that agree, as item and span."""
    for batch in batches:
        doc, item, span = [], [], []
        for d, i, at, size, x, y in zip(*(batch.column(c).to_pylist() for c in ("doc", "item_id", "begin", "size", "x", "y"))):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(a) and (best := agreement(a, b, min(window, size), share)):
                start = at + best[0]
                doc.append(d)
                item.append(i)
                span.append(_span(i, start, start + min(window, len(a)), best[1]))
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(span, pa.string())], ["doc", "item_id", "span"])


def joined_finds(rows: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """(rid, doc_id, item_ids, spans) of every one of ``rows(rid, doc_id, text)``, by a shuffled join of seeds."""
    items = settle(items.mapInArrow(item_batches, "item long, item_id long, size int, token binary, key array<long>, place array<int>"), "items")
    seeds = settle(items.select("item", "size", F.explode(F.arrays_zip("key", "place")).alias("s")).select("item", "size", "s.key", F.col("s.place").alias("q")), "seeds")
    # at most 2 ^ (BITMAP_BITS - 6) words reach the driver, and lengths under LONG
    bit = F.shiftrightunsigned("key", 64 - BITMAP_BITS)
    words = seeds.select(F.shiftrightunsigned(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP_BITS}) & 63 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    near = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    near[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    masks = all_masks({r[0] for r in items.select(F.least("size", F.lit(LONG))).distinct().collect()})
    held = settle(rows.mapInArrow(lambda it: probe_batches(it, masks, near), "doc long, rid long, doc_id long, n int, h binary, key array<long>, place array<int>"), "probes")
    hits = held.select("doc", "n", F.explode(F.arrays_zip("key", "place")).alias("s")).select("doc", "n", "s.key", F.col("s.place").alias("p"))
    pairs = settle(hits.join(seeds, "key").select("doc", "item", "n", "size", (F.col("p") - F.col("q")).alias("at")).distinct(), "pairs")
    begin, end = F.greatest("at", F.lit(0)), F.least(F.col("at") + F.col("size"), "n")
    pairs = pairs.select("doc", "item", "size", "at", begin.alias("begin"), (end - begin).alias("run"))
    cut = lambda c, start: F.substring(c, (8 * start + 1).cast("int"), (8 * F.col("run")).cast("int"))
    pairs = pairs.join(items.select("item", "item_id", "token"), "item").withColumn("y", cut("token", F.col("begin") - F.col("at"))).drop("token", "item")
    pairs = pairs.join(held.where("h is not null").select("doc", "h"), "doc").select("doc", "item_id", "begin", "size", cut("h", F.col("begin")).alias("x"), "y")
    found = pairs.mapInArrow(lambda it: verify_batches(it, window, share), "doc long, item_id long, span string")
    found = settle(found.groupBy("doc").agg(F.collect_set(F.struct(F.col("item_id").isNull().alias("last"), "item_id")).alias("ids"), F.collect_set("span").alias("spans")), "finds")
    return held.select("doc", "rid", "doc_id").join(found, "doc", "left").select(
        "rid",
        "doc_id",
        F.coalesce(F.transform(F.array_sort("ids"), lambda x: x["item_id"]), F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<string>")).alias("spans"),
    )


def benchmark_items(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, Seeds | None]:
    """The items, and their seeds where their text is at most ``block_bytes``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > block_bytes:
        return items, None
    rows = sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return items, make_seeds([r[0] for r in rows], [r[1] for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted), spans (item:first:end:matches, in tokens, sorted as text)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, seeds = benchmark_items(benchmark, block_bytes)
    if seeds is None:
        found = joined_finds(texts.select(F.lit(0).cast("long").alias("rid"), "doc_id", "text"), items, window, share)
    else:
        found = texts.mapInArrow(lambda it: match_batches(it, seeds, window, share), "doc_id long, item_ids array<long>, spans array<string>")
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", F.array_sort("spans").alias("spans"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark passage.

    Texts are not shuffled where the benchmark's seeds fit a worker. Beyond that, rows are numbered in a settled copy and joined by number.
    """
    prepare(docs.sparkSession)
    items, seeds = benchmark_items(benchmark, block_bytes)
    if seeds is not None:
        return docs.mapInArrow(lambda it: clean_batches(it, seeds, window, share), docs.schema)
    copy = settle(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")), "numbered")
    texts = copy.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    flagged = joined_finds(texts, items, window, share).where(F.size("item_ids") > 0).select("rid")
    return copy.join(settle(flagged, "flagged").hint("merge"), "rid", "left_anti").select("row.*")
