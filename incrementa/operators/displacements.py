"""Scale bins and displacement lists (DSP-1..11)."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.operators.sampling import MIX, PRIME, stirred


def _rounded_geometric(lo: float, hi: float, n: int) -> list[float]:
    """Distinct half-even rounded points of a geometric sequence from lo to hi."""
    if n == 1:
        return [float(round(lo))]
    ratio = math.log(hi / lo) / (n - 1)
    points = [lo, *(lo * math.exp(ratio * k) for k in range(1, n - 1)), hi]
    return sorted({float(round(p)) for p in points})


def scale_edges(r_min: float, r_max: float, n_bins: int) -> list[float]:
    """Whole-number, about logarithmic edges of ``n_bins`` scale bins; fewer, with a warning, where the range has no more."""
    if r_min <= 0:
        raise ValueError("r_min must be positive")
    if r_max <= r_min:
        raise ValueError("r_max must exceed r_min")
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    lo, hi = n_bins + 1, min(3 * n_bins, 1000)
    if n_bins == 1:
        hi = max(hi, lo)
    if lo > hi:
        raise ValueError("n_bins must be under 1000")
    best: list[float] = []
    while lo <= hi:
        mid = (lo + hi) // 2
        edges = _rounded_geometric(r_min, r_max, mid)
        if not best or abs(len(edges) - n_bins - 1) < abs(len(best) - n_bins - 1):
            best = edges
        if len(edges) == n_bins + 1:
            break
        if len(edges) < n_bins + 1:
            lo = mid + 1
        else:
            hi = mid - 1
    if len(best) != n_bins + 1:
        warnings.warn(f"{len(best) - 1} scale bins instead of {n_bins}", stacklevel=2)
    return best


def largest_scale(rows: int, stencil_width: int = 2) -> int:
    """The largest displacement: a half, quarter or eighth of the rows by stencil width."""
    return rows // {2: 2, 3: 4}.get(stencil_width, 8)


def largest_scale_of(rows: Column, stencil_width: Column) -> Column:
    """As :func:`largest_scale` for columns."""
    return F.floor(rows / F.when(stencil_width == 2, 2).when(stencil_width == 3, 4).otherwise(8)).cast("int")


def quota_of(n_total: Column, n_bins: Column) -> Column:
    """As :func:`quota` for columns; null where a number is not positive."""
    return F.when((n_total > 0) & (n_bins > 0), F.greatest(F.lit(1), F.floor(n_total / n_bins).cast("int")))


def quota(n_total: int, n_bins: int) -> int:
    """Candidates a scale bin."""
    if n_total <= 0:
        raise ValueError("n_total must be positive")
    each = max(1, n_total // n_bins)
    if each < 10:
        warnings.warn(f"only {each} displacements in a scale bin", stacklevel=2)
    return each


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone: not on partitions, their order or the cluster."""
    at = F.lit(seed % PRIME).cast("long")
    for k, key in enumerate(keys):
        at = stirred((key.cast("long") + 1) * MIX[k % len(MIX)] % PRIME, at)
    return at / F.lit(float(PRIME))


def candidates(spark: SparkSession, edges: list[float], n_total: int, seed: int = 0) -> DataFrame:
    """(bin, k, dx, dy): radii geometric within each bin, both ends included, angles uniform in [0, pi), drawn by seed, bin and k."""
    if len(edges) < 2 or any(b <= a for a, b in zip(edges[:-1], edges[1:])):
        raise ValueError("edges must be two or more and increase")
    q = quota(n_total, len(edges) - 1)
    lit = F.array(*(F.lit(float(e)) for e in edges))
    rows = spark.range((len(edges) - 1) * q).select(F.floor(F.col("id") / q).cast("int").alias("bin"), (F.col("id") % q).cast("int").alias("k"))
    rows = rows.select("bin", "k", (draw(seed, F.col("bin"), F.col("k")) * math.pi).alias("angle"))
    lo, hi = F.get(lit, F.col("bin")), F.get(lit, F.col("bin") + 1)
    r = lo * F.exp(F.log(hi / lo) * F.col("k") / F.lit(max(q - 1, 1)))
    return rows.select("bin", "k", F.rint(r * F.cos("angle")).cast("int").alias("dx"), F.rint(r * F.sin("angle")).cast("int").alias("dy"))


def distinct_in_bin(raw: DataFrame) -> DataFrame:
    return raw.select("bin", "dx", "dy").distinct()


def without_zero(d: DataFrame) -> DataFrame:
    return d.where("dx <> 0 or dy <> 0")


def canonical(d: DataFrame) -> DataFrame:
    """Of two opposite vectors the one in the right half-plane."""
    flip = (F.col("dx") < 0) | ((F.col("dx") == 0) & (F.col("dy") < 0))
    return d.withColumns({"dx": F.when(flip, -F.col("dx")).otherwise(F.col("dx")), "dy": F.when(flip, -F.col("dy")).otherwise(F.col("dy"))})


def numbered(d: DataFrame) -> DataFrame:
    """(disp_id, di, dj) by length, then dx, dy. The list is bounded by the requested number of displacements."""
    order = W.orderBy(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), "dx", "dy")
    return d.select((F.row_number().over(order) - 1).alias("disp_id"), F.col("dx").alias("di"), F.col("dy").alias("dj"))


def displacement_list(spark: SparkSession, edges: list[float], n_total: int, seed: int = 0) -> DataFrame:
    """(disp_id, di, dj): distinct, non-zero, no two opposite."""
    raw = without_zero(distinct_in_bin(candidates(spark, edges, n_total, seed)))
    return numbered(canonical(raw).select("dx", "dy").distinct())
