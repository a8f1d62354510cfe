"""Merges, marginals, moments and curves of sparse histograms and raw increments (AGG-4..19, POST-1..5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.functions.binning import PHI_BINS, THETA_BINS, bin_index, logspace
from incrementa.functions.vectors import Vec, minus, norm


def merged(parts: list[DataFrame], extra: tuple[str, ...] = ()) -> DataFrame:
    """Sum of histograms, of workers or of slices; ``extra`` columns, such as slice_id, are summed over."""
    every = reduce(DataFrame.unionByName, parts)
    keys = [c for c in every.columns if c != "count" and c not in extra]
    return every.groupBy(*keys).agg(F.sum("count").alias("count"))


def marginal(hist: DataFrame, *keys: str) -> DataFrame:
    """Counts by channel and ``keys``, all else summed over."""
    return hist.groupBy("channel", *keys).agg(F.sum("count").alias("count"))


#: sets of bins over which :func:`marginals` sums
MARGINALS = [("ell_bin",), ("ell_bin", "theta_bin", "phi_bin"), ("ell_bin", "sf_bin"), ()]


def marginals(hist: DataFrame, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(over, channel, bins, count): all marginals of a histogram from one pass over it, ``over`` naming the bins that are kept.

    Sums by grouping sets: the histogram is made once from its samples, spread over the sets and summed in one
    aggregate. Bins that a row is summed over are -1.
    """
    sets = MARGINALS if sets is None else sets
    bins = [c for c in hist.columns if c not in ("channel", "count")]
    keep = lambda s: F.struct(F.lit(",".join(s)).alias("over"), *(F.col(c) if c in s else F.lit(-1).alias(c) for c in bins))
    spread = hist.select("channel", "count", F.explode(F.array(*map(keep, sets))).alias("__s")).select("channel", "count", "__s.*")
    return spread.groupBy("over", "channel", *bins).agg(F.sum("count").alias("count"))


def at_scale(hist: DataFrame, ell_bin: int, *keys: str) -> DataFrame:
    """Counts by channel and ``keys`` in one scale bin."""
    return marginal(hist.where(F.col("ell_bin") == ell_bin), *keys)


def _edge_table(edges: list[float]) -> Column:
    return F.array(*(F.lit(0.5 * (a + b)) for a, b in zip(edges[:-1], edges[1:])))


def moments(hist: DataFrame, scale_edges: list[float], value_edges: list[float], order: int = 2) -> DataFrame:
    """(channel, ell_bin, ell_center, sf_p, count): mean of centre ** order, to the power 1 / order; a scale bin without counts has 0."""
    c = F.get(_edge_table(value_edges), F.col("sf_bin"))
    power = reduce(lambda a, b: a * b, [c] * order) if order == int(order) and 1 <= order <= 8 else F.pow(c, F.lit(float(order)))
    got = hist.groupBy("channel", "ell_bin").agg((F.sum(F.col("count") * power) / F.sum("count")).alias("mean"), F.sum("count").alias("count"))
    root = F.sqrt("mean") if order == 2 else F.pow("mean", F.lit(1.0 / order))
    every = hist.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0), F.lit(len(scale_edges) - 2))).alias("ell_bin"))
    full = every.join(got.withColumn("sf_p", root), ["channel", "ell_bin"], "left")
    return full.select("channel", "ell_bin", F.get(_edge_table(scale_edges), F.col("ell_bin")).alias("ell_center"), F.coalesce("sf_p", F.lit(0.0)).alias("sf_p"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def counted_scales(curves: DataFrame, channel: str = "D_V") -> DataFrame:
    """Rows of the scale bins in which ``channel`` has counts."""
    return curves.join(curves.where((F.col("channel") == channel) & (F.col("count") > 0)).select("ell_bin").distinct(), "ell_bin", "left_semi")


def channel_totals(hist: DataFrame, channels: list[str]) -> DataFrame:
    """(channel, total, grand_total, empty) for every channel of the catalogue, those without counts too."""
    spark = hist.sparkSession
    got = hist.groupBy("channel").agg(F.sum("count").alias("total"))
    every = spark.createDataFrame([(c,) for c in channels], "channel string").join(got, "channel", "left").select("channel", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    grand = got.agg(F.coalesce(F.sum("total"), F.lit(0).cast("long")).alias("grand_total"))
    return every.crossJoin(grand).withColumn("empty", F.col("total") == 0)  # one row


def angular_coverage(hist: DataFrame) -> DataFrame:
    """(coverage): percentage of (theta, phi) bins that hold anything."""
    return hist.agg((F.countDistinct("theta_bin", "phi_bin") / F.lit(float(THETA_BINS * PHI_BINS)) * 100).alias("coverage"))


def scale_coverage(hist: DataFrame) -> DataFrame:
    """(coverage): non-empty (scale, theta) bins over the number of (theta, phi) bins, which can pass 100."""
    return hist.agg((F.countDistinct("ell_bin", "theta_bin") / F.lit(float(THETA_BINS * PHI_BINS)) * 100).alias("coverage"))


def raw_increments(gathered: DataFrame) -> DataFrame:
    """([slice_id,] disp_id, r, dv, db, drho) of a two-point gather; no frame, no bins."""
    d = lambda name: norm(minus(Vec.of(name, "__1"), Vec.of(name, "__0")))
    return gathered.select(*(["slice_id"] if "slice_id" in gathered.columns else []), "disp_id", "r", d("v").alias("dv"), d("b").alias("db"), F.abs(F.col("rho__1") - F.col("rho__0")).alias("drho"))


def raw_ranges(raw: DataFrame) -> DataFrame:
    """(field, least, most, n) of each raw increment."""
    got = raw.agg(*(x for c in ("dv", "db", "drho") for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))), F.count("*").alias("n"))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_lo").alias("least"), F.col(f"{c}_hi").alias("most"), F.col("n").alias("n")) for c in ("dv", "db", "drho")))).alias("x")).select("x.*")


def plot_scales(raw: DataFrame, n_edges: int = 20) -> list[float]:
    """Logarithmic edges from the least to the largest r; two numbers reach the driver."""
    lo, hi = raw.agg(F.min("r"), F.max("r")).first()
    edges = logspace(0, 1, n_edges) if lo is None or lo == hi else [lo * (hi / lo) ** (k / (n_edges - 1)) for k in range(n_edges)]
    return edges if lo is None or lo == hi else [lo, *edges[1:-1], hi]


def binned_means(raw: DataFrame, edges: list[float]) -> DataFrame:
    """(r_bin, n, dv, db, drho): means by scale bin; empty bins, and bins with a NaN mean, are left out."""
    got = raw.withColumn("r_bin", bin_index(F.col("r"), edges)).where("r_bin >= 0").groupBy("r_bin").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("dv", "db", "drho")))
    return got.where(~(F.isnan("dv") | F.isnan("db") | F.isnan("drho")))


def density(raw: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(pdf_bin, n, density): equally wide bins from least to most, the last closed."""
    span = raw.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("total"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    k = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    rows = raw.select(column).crossJoin(F.broadcast(span)).where("hi > lo")  # one row
    got = rows.groupBy(k.alias("pdf_bin"), width.alias("width"), "total").agg(F.count("*").alias("n"))
    return got.select("pdf_bin", "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def field_statistics(df: DataFrame) -> DataFrame:
    """(field, least, most, mean) of density and of the speeds |v| and |B|."""
    cols = {"rho": F.col("rho"), "v": norm(Vec.of("v")), "b": norm(Vec.of("b"))}
    got = df.select(*(v.alias(k) for k, v in cols.items())).agg(*(x for c in cols for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.avg(c).alias(f"{c}_mean"))))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_lo").alias("least"), F.col(f"{c}_hi").alias("most"), F.col(f"{c}_mean").alias("mean")) for c in cols))).alias("x")).select("x.*")


def ranges_without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, least, most, all_nan) of each column, NaN skipped; Spark's own max would be NaN."""
    got = df.agg(*(x for c in columns for x in (F.min(F.when(~F.isnan(c), F.col(c))).alias(f"{c}__lo"), F.max(F.when(~F.isnan(c), F.col(c))).alias(f"{c}__hi"))))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}__lo").alias("least"), F.col(f"{c}__hi").alias("most"), F.col(f"{c}__lo").isNull().alias("all_nan")) for c in columns))).alias("x")).select("x.*")


def evaluations(samples: DataFrame) -> DataFrame:
    """(displacements, evaluations) of a sample table."""
    return samples.agg(F.countDistinct("disp_id").alias("displacements"), F.count("*").alias("evaluations"))


def local_slopes(curves: DataFrame, window: int = 4) -> DataFrame:
    """(channel, ell_mid, slope): least-squares slope of log value over log scale in each run of four scales."""
    points = curves.where("sf_p > 0 and ell_center > 0").select("channel", "ell_bin", F.log10("ell_center").alias("x"), F.log10("sf_p").alias("y"))
    order = W.partitionBy("channel").orderBy("ell_bin")
    frame = order.rowsBetween(0, window - 1)
    got = points.select("channel", "ell_bin", F.regr_slope("y", "x").over(frame).alias("slope"), F.count("*").over(frame).alias("n"), F.lead("x", window // 2 - 1).over(order).alias("x1"), F.lead("x", window // 2).over(order).alias("x2"))
    return got.where(F.col("n") == window).select("channel", "ell_bin", F.pow(F.lit(10.0), (F.col("x1") + F.col("x2")) / 2).alias("ell_mid"), "slope")


def reference_curve(curves: DataFrame, exponent: float) -> DataFrame:
    """(channel, ell_bin, reference): C * ell ** exponent through each channel's middle point."""
    order = W.partitionBy("channel").orderBy("ell_bin")
    ranked = curves.where("count > 0").select("channel", "ell_bin", "ell_center", "sf_p", (F.row_number().over(order) - 1).alias("k"), F.count("*").over(W.partitionBy("channel")).alias("n"))
    middle = ranked.where(F.col("k") == F.floor(F.col("n") / 2)).select("channel", (F.col("sf_p") / F.pow("ell_center", F.lit(exponent))).alias("c"))
    return ranked.join(middle, "channel").select("channel", "ell_bin", (F.col("c") * F.pow("ell_center", F.lit(exponent))).alias("reference"))


def asymmetry(curves: DataFrame, left: str = "D_ZPLUS", right: str = "D_ZMINUS") -> DataFrame:
    """(ell_bin, ratio) of two channels' moments; null where the second is 0."""
    a = curves.where(F.col("channel") == left).select("ell_bin", F.col("sf_p").alias("a"))
    b = curves.where(F.col("channel") == right).select("ell_bin", F.col("sf_p").alias("b"))
    return a.join(b, "ell_bin").select("ell_bin", F.try_divide("a", "b").alias("ratio"))


def count_angles(products: DataFrame, cross_channel: str, magnitude_channel: str) -> DataFrame:
    """(ell_bin, product_bin, angle): arcsine of a ratio of counts, clipped to 1, as documented for the two channels' histograms."""
    a = products.where(F.col("channel") == cross_channel).select("ell_bin", "product_bin", F.col("count").alias("a"))
    b = products.where(F.col("channel") == magnitude_channel).select("ell_bin", "product_bin", F.col("count").alias("b"))
    ratio = F.coalesce("a", F.lit(0)) / (F.coalesce("b", F.lit(0)) + F.lit(1e-10))
    return a.join(b, ["ell_bin", "product_bin"], "full").select("ell_bin", "product_bin", F.asin(F.least(ratio, F.lit(1.0))).alias("angle"))


def compared(curves: dict[str, DataFrame]) -> DataFrame:
    """Curves of several results under their labels."""
    return reduce(DataFrame.unionByName, [df.withColumn("label", F.lit(name)) for name, df in curves.items()])
