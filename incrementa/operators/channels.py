"""Local frame and the 28 channels (GEO-1..8, CH-00..27), and their histograms (AGG-1, AGG-2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incrementa.functions.binning import even_bin, log_bin, phi_edges, product_edges, theta_edges, value_edges
from incrementa.functions.vectors import Vec, cross, dot, minus, norm, over, times
from incrementa.operators.sampling import displacement_vector, increment, stencil_mean

#: fixed values: channels in the order of either family; a vector of increments for the first, a pair for the second
MAGNITUDES = {"D_V": "v", "D_B": "b", "D_RHO": "rho", "D_VA": "va", "D_ZPLUS": "zp", "D_ZMINUS": "zm", "D_OMEGA": "omega", "D_J": "j", "D_CURV": "curv", "D_GRAD_RHO": "grad_rho"}
#: fixed values: name, kind, the two vectors
PRODUCTS = {
    "D_Vperp_CROSS_Bperp": ("perp_cross", "v", "b"),
    "D_Vperp_CROSS_VAperp": ("perp_cross", "v", "va"),
    "D_Vperp_CROSS_Omegaperp": ("perp_cross", "v", "omega"),
    "D_Bperp_CROSS_Jperp": ("perp_cross", "b", "j"),
    "D_Vperp_D_Bperp_MAG": ("perp_mag", "v", "b"),
    "D_Vperp_D_VAperp_MAG": ("perp_mag", "v", "va"),
    "D_Vperp_D_Omegaperp_MAG": ("perp_mag", "v", "omega"),
    "D_Bperp_D_Jperp_MAG": ("perp_mag", "b", "j"),
    "D_V_CROSS_B": ("cross", "v", "b"),
    "D_V_CROSS_VA": ("cross", "v", "va"),
    "D_V_CROSS_OMEGA": ("cross", "v", "omega"),
    "D_B_CROSS_J": ("cross", "b", "j"),
    "D_V_D_B_MAG": ("mag", "v", "b"),
    "D_V_D_VA_MAG": ("mag", "v", "va"),
    "D_V_D_OMEGA_MAG": ("mag", "v", "omega"),
    "D_B_D_J_MAG": ("mag", "b", "j"),
    "D_CURV_CROSS_GRAD_RHO": ("cross", "curv", "grad_rho"),
    "D_CURV_D_GRAD_RHO_MAG": ("mag", "curv", "grad_rho"),
}
VECTORS = ["v", "b", "va", "zp", "zm", "omega", "j", "curv", "grad_rho"]
WEAK = 1e-10


def vector_columns(names: Iterable[str]) -> list[str]:
    return [x for n in names for x in ([n] if n == "rho" else [f"{n}_{c}" for c in "xyz"])]


def vectors_of(channels: Iterable[str]) -> list[str]:
    """Field vectors that the channels and the frame need."""
    need = {"b"}
    for c in channels:
        need |= {MAGNITUDES[c]} if c in MAGNITUDES else set(PRODUCTS[c][1:])
    return [v for v in [*VECTORS, "rho"] if v in need]


def increments(gathered: DataFrame, vectors: list[str], keep: list[str], width: int = 2) -> DataFrame:
    """``keep`` with d_<field> for each component and the mean field m_x, m_y, m_z."""
    parts = [increment(c, width).alias(f"d_{c}") for c in vector_columns(vectors)]
    return gathered.select(*keep, *parts, *(stencil_mean(f"b_{c}", width).alias(f"m_{c}") for c in "xyz"))


def clamped(c: Column, lo: float | None) -> Column:
    """min(c, 1), and max(lo) where given, with NaN kept; Spark's least would turn NaN into 1."""
    inner = F.least(c, F.lit(1.0)) if lo is None else F.greatest(F.least(c, F.lit(1.0)), F.lit(lo))
    return F.when(F.isnan(c), c).otherwise(inner)


def local_frame(inc: DataFrame, axis: int, keep: list[str], whole: bool = False) -> DataFrame:
    """Adds theta, phi and the unit field u_*; drops samples whose mean field vanishes. ``whole``: with the vectors on the way (e_*: the displacement across the field)."""
    m, d, r = Vec.of("m"), displacement_vector(axis), F.col("r")
    s = inc.withColumn("m_mag", norm(m)).where(~(F.col("m_mag") < WEAK))
    db = Vec.of("d_b")
    # the filter may run together with what follows, which therefore must not divide by zero
    size = F.when(F.col("m_mag") < WEAK, F.lit(1.0)).otherwise(F.col("m_mag"))
    s = s.withColumns({"cos_theta": F.abs(dot(d, m)) / (r * size), **{f"u_{c}": x for c, x in zip("xyz", over(m, size))}})
    u = Vec.of("u")
    s = s.withColumns({"along": dot(d, m) / (size * size), "b_along": dot(db, u)})
    s = s.withColumns({f"e_{c}": x for c, x in zip("xyz", minus(d, times(m, F.col("along"))))} | {f"p_{c}": x for c, x in zip("xyz", minus(db, times(u, F.col("b_along"))))})
    e, p = Vec.of("e"), Vec.of("p")
    s = s.withColumns({"e_mag": norm(e), "p_mag": norm(p)})
    turned = (F.col("e_mag") > 0) & (F.col("p_mag") > 0) & ~F.isnan("e_mag") & ~F.isnan("p_mag")
    cos_phi = dot(e, p) / F.when(turned, F.col("e_mag") * F.col("p_mag")).otherwise(F.lit(1.0))
    s = s.withColumn("theta", F.acos(clamped(F.col("cos_theta"), None)))
    s = s.withColumn("phi", F.when(turned, F.acos(clamped(cos_phi, -1.0))).otherwise(F.lit(0.0)))
    return s if whole else s.drop("cos_theta", "along", "b_along", "e_mag", "p_mag", *(f"{n}_{c}" for n in "ep" for c in "xyz"))


def angle_bins(framed: DataFrame, theta: list[float] | None = None, phi: list[float] | None = None) -> DataFrame:
    """Adds theta_bin, phi_bin; a sample outside either goes for all channels.

    The row number keeps the filter above this projection: pushed into the join below, it would compute the whole frame twice.
    """
    s = framed.withColumns({"theta_bin": even_bin(F.col("theta"), theta or theta_edges()), "phi_bin": even_bin(F.col("phi"), phi or phi_edges()), "row": F.monotonically_increasing_id()})
    return s.where("theta_bin >= 0 and phi_bin >= 0 and row >= 0").drop("theta", "phi", "row")


def perpendicular(name: str) -> Vec:
    """Increment of a vector without its part along the mean field."""
    a, u = Vec.of(f"d_{name}"), Vec.of("u")
    return minus(a, times(u, dot(a, u)))


def with_perpendiculars(framed: DataFrame, channels: list[str]) -> DataFrame:
    """Adds q_<vector> for the vectors whose perpendicular part the channels use, once for all of them."""
    need = sorted({n for c in channels if c in PRODUCTS and PRODUCTS[c][0].startswith("perp") for n in PRODUCTS[c][1:]})
    return framed.withColumns({f"q_{n}_{c}": x for n in need for c, x in zip("xyz", perpendicular(n))}) if need else framed


def channel_value(channel: str) -> Column:
    """Value of a channel over increments and, for some products, their perpendicular parts."""
    if channel in MAGNITUDES:
        name = MAGNITUDES[channel]
        return F.abs(F.col("d_rho")) if name == "rho" else norm(Vec.of(f"d_{name}"))
    kind, a, b = PRODUCTS[channel]
    left, right = (Vec.of(f"q_{n}" if kind.startswith("perp") else f"d_{n}") for n in (a, b))
    return norm(cross(left, right)) if kind.endswith("cross") else norm(left) * norm(right)


def channel_values(framed: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """(keys, k, value): a row for each sample and channel.

    The values are an array column before they are exploded, and the row number keeps the two apart: generated into
    one method, so many expressions pass the size up to which the JVM compiles, and run interpreted.
    """
    rows = with_perpendiculars(framed, channels).select(*keys, F.array(*(channel_value(c) for c in channels)).alias("__values"), F.monotonically_increasing_id().alias("__row"))
    return rows.where("__row >= 0").select(*keys, F.posexplode("__values").alias("k", "value"))


def _counted(framed: DataFrame, channels: list[str], keys: list[str], edges: list[float], out: str) -> DataFrame:
    """One posexplode of the channels' values, one bin search each, one hash aggregate combined map-side."""
    names = F.array(*(F.lit(c) for c in channels))
    rows = channel_values(framed, channels, keys).select(*keys, "k", log_bin(F.col("value"), edges).alias(out)).where(F.col(out) >= 0)
    counted = rows.groupBy("k", *keys, out).agg(F.count("*").alias("count"))
    return counted.select(F.get(names, F.col("k")).alias("channel"), *keys, out, "count")


def magnitude_histogram(framed: DataFrame, channels: list[str] | None = None, edges: list[float] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(channel, ell_bin, theta_bin, phi_bin, sf_bin, count), sparse."""
    return _counted(framed, channels or list(MAGNITUDES), [*extra, "ell_bin", "theta_bin", "phi_bin"], edges or value_edges(), "sf_bin")


def product_histogram(framed: DataFrame, channels: list[str] | None = None, edges: list[float] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(channel, ell_bin, product_bin, count), sparse."""
    return _counted(framed, channels or list(PRODUCTS), [*extra, "ell_bin"], edges or product_edges(), "product_bin")


def all_histograms(framed: DataFrame, sf_edges: list[float] | None = None, other_edges: list[float] | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Both families in one pass over the samples: (channel, ell_bin, theta_bin, phi_bin, value_bin, count), angles -1 for products."""
    channels, first = [*MAGNITUDES, *PRODUCTS], len(MAGNITUDES)
    names = F.array(*(F.lit(c) for c in channels))
    keys = [*extra, "ell_bin"]
    rows = channel_values(framed, channels, [*keys, "theta_bin", "phi_bin"])
    angled = F.col("k") < first
    bins = F.when(angled, log_bin(F.col("value"), sf_edges or value_edges())).otherwise(log_bin(F.col("value"), other_edges or product_edges()))
    rows = rows.select(*keys, "k", *(F.when(angled, F.col(c)).otherwise(F.lit(-1)).alias(c) for c in ("theta_bin", "phi_bin")), bins.alias("value_bin")).where("value_bin >= 0")
    counted = rows.groupBy("k", *keys, "theta_bin", "phi_bin", "value_bin").agg(F.count("*").alias("count"))
    return counted.select(F.get(names, F.col("k")).alias("channel"), *keys, "theta_bin", "phi_bin", "value_bin", "count")
