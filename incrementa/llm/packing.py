"""Best-fit packing by length patterns fitted with non-negative least squares.

Documents are tokenised once; what is kept of a piece is its length, a checksum and its rank among
pieces of that length in its own task. The histogram of lengths (at most ``capacity`` rows) goes
to the driver, which enumerates the patterns of one to three lengths that fill a sequence exactly,
fits their repeat counts to the histogram by non-negative least squares, rounds them within what
the histogram holds, and packs what is left best-fit, longest first. The fitted plan, bounded by
the number of patterns, is looked up by each piece's global rank within its length, so no piece is
moved to its neighbours and no length, however common, meets in one task.

Edge cases: null text is empty and packs its end id; repeated rows are packed each; a document
longer than a sequence is cut with the short piece first; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.llm.common import heaps, prepare, settle
from incrementa.llm.tokens import Encoder, vocabulary_path

ROUNDS = 150
#: bytes of text whose distinct pieces are looked up together
HEAP_BYTES = 8 << 20

Plan = list[tuple[tuple[int, ...], int]]


def exact_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns a >= b >= c (0: none) over lengths present whose sum is ``capacity``."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    have[0] = True
    found = []
    for c in np.flatnonzero(have):
        b = np.flatnonzero(have[c : (capacity - c) // 2 + 1]) + c
        a = capacity - c - b
        ok = have[a] & (a >= b) & (a > 0) & ((b > 0) | (c == 0))
        found.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], 1))
    return np.concatenate(found)


def fit(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 minimising the weighted squared error of patterns against the histogram (accelerated projected gradient)."""
    n, size = len(patterns), len(histogram)
    weight = np.sqrt(np.arange(size) / (size - 1))
    weight[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(patterns[:, k], weights=x, minlength=size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        w = weight * r
        return w[patterns[:, 0]] + w[patterns[:, 1]] + w[patterns[:, 2]]

    probe = np.ones(n)
    for _ in range(8):  # largest eigenvalue by power iteration
        probe = back(forward(probe))
        top = np.linalg.norm(probe)
        probe /= top
    goal, x, y, t = weight * histogram, np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        step = np.maximum(0, y - back(forward(y) - goal) / (1.05 * top))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = step + (t - 1) / t_next * (step - x), step, t_next
    return x


def round_down_into(patterns: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[Plan, np.ndarray]:
    """Whole repeats, the fitted ones rounded down, taken largest first while the histogram holds them; and what is left."""
    left = histogram.copy().tolist()
    plan: Plan = []
    for k in np.argsort(-x, kind="stable").tolist():
        lengths = [v for v in patterns[k].tolist() if v]
        most = min(left[v] // lengths.count(v) for v in lengths)
        repeat = min(most, int(x[k]))
        if repeat > 0:
            for v in lengths:
                left[v] -= repeat
            plan.append((tuple(lengths), repeat))
    return plan, np.array(left, np.int64)


def best_fit(histogram: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over counts: equal open sequences are handled together."""
    open_by_room: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        count = int(histogram[length])
        while count:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = int(fitting[0]) + length
                lengths, have = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms[room] = False
                take = min(have, count)
                if have > take:
                    open_by_room[room].append([lengths, have - take])
                    rooms[room] = True
            else:
                room, lengths = capacity, ()
                fill = capacity // length
                take = count // fill
                if take:  # as many full stacks of this length as there are
                    rest = capacity - fill * length
                    open_by_room.setdefault(rest, []).append([(length,) * fill, take])
                    rooms[rest] = True
                    count -= take * fill
                    continue
                fill, take = count, 1
                rest = capacity - fill * length
                open_by_room.setdefault(rest, []).append([(length,) * fill, 1])
                rooms[rest] = True
                count = 0
                continue
            rest = room - length
            open_by_room.setdefault(rest, []).append([(*lengths, length), take])
            rooms[rest] = True
            count -= take
    return [(tuple(lengths), n) for groups in open_by_room.values() for lengths, n in groups]


def plan_packing(histogram: np.ndarray, capacity: int) -> Plan:
    """Patterns with repeats that hold every piece of ``histogram`` (index: length)."""
    full: Plan = [((capacity,), int(histogram[capacity]))] if histogram[capacity] else []
    rest = histogram.copy()
    rest[capacity] = 0
    rest[0] = 0
    if not rest.any():
        return full
    patterns = exact_patterns(np.flatnonzero(rest), capacity)
    fitted: Plan = []
    if len(patterns):
        fitted, rest = round_down_into(patterns, fit(patterns, rest), rest)
    return full + fitted + best_fit(rest, capacity)


def intervals(plan: Plan, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first rank), with the sequence of that rank and the place in it."""
    taken = [0] * (capacity + 1)
    rows, base = [], 0
    for lengths, repeat in plan:
        at = 0
        for v in lengths:
            rows.append((v << 40 | taken[v], base, at))
            taken[v] += repeat
            at += v
        base += repeat
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def piece_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(tokenizer)
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    end = np.array([end_id], encoder.dtype).tobytes()
    for batch in heaps(batches, "text", HEAP_BYTES):
        row, piece, start, length, crc = [], [], [], [], []
        for i, x in enumerate(encoder.encode(batch.column("text"))):
            ids = memoryview(np.frombuffer(x + end, encoder.dtype).astype("<u4").tobytes())
            n = len(ids) // 4
            at = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                row.append(i)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(ids[4 * a : 4 * b]))
        size = np.array(length, np.int64)
        order = np.argsort(size, kind="stable")
        ranked = size[order]
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size)) - np.searchsorted(ranked, ranked) + seen[ranked]
        seen += np.bincount(size, minlength=capacity + 1)
        yield pa.record_batch(
            [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
        )


def place_batches(batches: Iterator[pa.RecordBatch], key: np.ndarray, sequence: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        want = batch.column("length").to_numpy() << 40 | batch.column("rank").to_numpy()
        k = np.searchsorted(key, want, side="right") - 1
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(sequence[k] + want - key[k]), pa.array(place[k])], [*keep, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(docs.sparkSession)
    tokenizer = tokenizer or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settle(docs.mapInArrow(lambda it: piece_batches(it, tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    counts = settle(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most `capacity` rows reach the driver
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    key, sequence, place = intervals(plan_packing(histogram, capacity), capacity)
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(settle(before, "before"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(lambda it: place_batches(it, key, sequence, place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
