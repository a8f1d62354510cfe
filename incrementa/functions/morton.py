"""Meshblock order: 18-bit Morton codes (VOL-1, VOL-2) and the layout of blocks over ranks (VOL-3..5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 6


def encode(a: Column, b: Column, c: Column) -> Column:
    """Bit k of a, b, c goes to bits 3k, 3k + 1, 3k + 2; null outside 0..63."""
    code = F.lit(0)
    for k in range(BITS):
        for place, v in enumerate((a, b, c)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), 3 * k + place))
    inside = a.between(0, 63) & b.between(0, 63) & c.between(0, 63)
    return F.when(inside, code)


def decode(n: Column) -> tuple[Column, Column, Column]:
    """(third, second, first) argument of :func:`encode`, in the reversed order its users expect."""
    out = []
    for place in (2, 1, 0):
        v = F.lit(0)
        for k in range(BITS):
            v = v.bitwiseOR(F.shiftleft(F.shiftright(n, 3 * k + place).bitwiseAND(F.lit(1)), k))
        out.append(v)
    return tuple(out)


def encode_int(a: int, b: int, c: int) -> int:
    if not all(0 <= v <= 63 for v in (a, b, c)):
        raise ValueError("Morton components must be in 0..63")
    return sum((v >> k & 1) << (3 * k + p) for k in range(BITS) for p, v in enumerate((a, b, c)))


def decode_int(n: int) -> list[int]:
    if not 0 <= n < 1 << 3 * BITS:
        raise ValueError("Morton code must be in 0..2**18 - 1")
    return [sum((n >> (3 * k + p) & 1) << k for k in range(BITS)) for p in (2, 1, 0)]


def rank_of(gid: Column, blocks: int, ranks: int) -> tuple[Column, Column]:
    """(rank, place in the rank): the first ``blocks % ranks`` ranks hold one more."""
    q, m = divmod(blocks, ranks)
    cut = (q + 1) * m
    early = gid < cut
    rank = F.when(early, F.floor(gid / F.lit(q + 1))).otherwise(m + F.floor((gid - cut) / F.lit(max(q, 1))))
    local = F.when(early, gid % F.lit(q + 1)).otherwise((gid - cut) % F.lit(max(q, 1)))
    return rank.cast("int"), local.cast("int")


def block_bounds(index: Column, block: int, n: int) -> tuple[Column, Column]:
    """Edges of a block along one axis of a unit box centred at 0."""
    lo = F.lit(-0.5) + index * F.lit(block / n)
    return lo, lo + F.lit(block / n)


def slice_index(value: float, n: int) -> int:
    """Cell that holds ``value``; a value on a face belongs to the cell below it, -0.5 to none."""
    faces = [-0.5 + k / n for k in range(n + 1)]
    import bisect

    k = bisect.bisect_left(faces, value) - 1
    if not 0 <= k < n:
        raise ValueError(f"slice value {value} is outside the box")
    return k


def cell_of(value: Column, n: int) -> Column:
    """As :func:`slice_index` for a column of values; null outside the box."""
    face = lambda k: F.lit(-0.5) + k / F.lit(n)
    k = F.ceil((value + 0.5) * n).cast("int") - 1
    # the product may be a last digit off the face that it is compared with
    k = k - F.when(face(k) >= value, 1).otherwise(0) + F.when(face(k + 1) < value, 1).otherwise(0)
    return F.when(k.between(0, n - 1), k)
