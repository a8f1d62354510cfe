"""Bin edges and the bin search (BIN-1..7): half-open bins [lo, hi), -1 outside and for NaN."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

THETA_BINS, PHI_BINS, VALUE_EDGES = 18, 18, 128


def linspace(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + k * step for k in range(n - 1)] + [hi]


def logspace(lo: float, hi: float, n: int) -> list[float]:
    return [10.0**e for e in linspace(lo, hi, n)]


def theta_edges() -> list[float]:
    return linspace(0.0, math.pi / 2, THETA_BINS + 1)


def phi_edges() -> list[float]:
    return linspace(0.0, math.pi, PHI_BINS + 1)


def value_edges() -> list[float]:
    return logspace(-4, 1, VALUE_EDGES)


def product_edges() -> list[float]:
    return logspace(-5, 5, VALUE_EDGES)


@dataclass(frozen=True)
class Binning:
    """Bins of a run: numbers of angle bins, edges of the two value families as (least, most), their number."""

    n_theta_bins: int = THETA_BINS
    n_phi_bins: int = PHI_BINS
    sf_range: tuple[float, float] = (1e-4, 1e1)
    product_range: tuple[float, float] = (1e-5, 1e5)
    n_value_edges: int = VALUE_EDGES

    def __post_init__(self) -> None:
        if self.n_theta_bins < 1 or self.n_phi_bins < 1 or self.n_value_edges < 2:
            raise ValueError("there has to be a bin")
        for name in ("sf_range", "product_range"):
            lo, hi = getattr(self, name)
            if not 0 < lo < hi:
                raise ValueError(f"{name} must be positive and increase")

    @property
    def theta(self) -> list[float]:
        return linspace(0.0, math.pi / 2, self.n_theta_bins + 1)

    @property
    def phi(self) -> list[float]:
        return linspace(0.0, math.pi, self.n_phi_bins + 1)

    @property
    def sf(self) -> list[float]:
        return logspace(math.log10(self.sf_range[0]), math.log10(self.sf_range[1]), self.n_value_edges)

    @property
    def product(self) -> list[float]:
        return logspace(math.log10(self.product_range[0]), math.log10(self.product_range[1]), self.n_value_edges)


#: edges up to which a bin is found by a tree of comparisons
TREE = 40


def centres(edges: list[float]) -> list[float]:
    """Arithmetic bin centres, for logarithmic bins as well."""
    return [0.5 * (a + b) for a, b in zip(edges[:-1], edges[1:])]


def centre_of(bin_number: Column, edges: list[float]) -> Column:
    """Centre of a bin by its number; null for -1."""
    return F.get(F.array(*(F.lit(c) for c in centres(edges))), bin_number)


def _literal(edges: list[float]) -> Column:
    return F.array(*(F.lit(float(e)) for e in edges))


def bin_index(value: Column, edges: list[float]) -> Column:
    """Any ascending edges: the number of edges at or below the value, less one, by bisection.

    Up to TREE edges are a tree of comparisons in generated code; more are searched step by step in an array, with
    as many steps as their number has binary digits.
    """
    if len(edges) < 2:
        raise ValueError("there has to be a bin")
    inside = (value >= edges[0]) & (value < edges[-1]) & ~F.isnan(value)
    if len(edges) <= TREE:

        def below(lo: int, hi: int) -> Column:
            """Bin of a value that lies in bins lo to hi."""
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi + 1) // 2
            return F.when(value < edges[mid], below(lo, mid - 1)).otherwise(below(mid, hi))

        return F.when(inside, below(0, len(edges) - 2)).otherwise(F.lit(-1))
    lit = _literal(edges)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(lit, at + step) <= value, at + step).otherwise(at))
    return F.when(inside, found).otherwise(F.lit(-1))


def _corrected(value: Column, guess: Column, edges: list[float]) -> Column:
    """A guess that may be one bin off, settled against the literal edges."""
    n, lit = len(edges) - 1, _literal(edges)
    k = F.least(F.greatest(guess.cast("int"), F.lit(0)), F.lit(n - 1))
    k = k - F.when(value < F.get(lit, k), 1).otherwise(0) + F.when(value >= F.get(lit, k + 1), 1).otherwise(0)
    return F.when(F.isnan(value) | (value < edges[0]) | (value >= edges[-1]), F.lit(-1)).otherwise(k)


def log_bin(value: Column, edges: list[float]) -> Column:
    """As :func:`bin_index` for logarithmic edges, by one logarithm instead of a scan of the edges."""
    lo, n = math.log(edges[0]), len(edges) - 1
    return _corrected(value, F.floor((F.log(F.greatest(value, F.lit(edges[0]))) - lo) * (n / (math.log(edges[-1]) - lo))), edges)


def even_bin(value: Column, edges: list[float]) -> Column:
    """As :func:`bin_index` for equally wide bins."""
    return _corrected(value, F.floor((value - edges[0]) * ((len(edges) - 1) / (edges[-1] - edges[0]))), edges)
