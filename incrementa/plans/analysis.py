"""Whole analyses (API-1..5, API-7): one lazy plan from slices to histograms."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incrementa.functions.binning import Binning
from incrementa.functions.physics import FLOOR, alfven, elsasser
from incrementa.operators.channels import MAGNITUDES, PRODUCTS, all_histograms, angle_bins, increments, local_frame, magnitude_histogram, product_histogram, vector_columns, vectors_of
from incrementa.operators.displacements import displacement_list, largest_scale, scale_edges
from incrementa.operators.sampling import gather, permuted_samples, with_scale
from incrementa.operators.statistics import raw_increments
from incrementa.sources.slices import check_dense, filled


class Result(NamedTuple):
    """Either family as its own lazy plan, and ``counts``: both from one pass, for when both are written."""

    magnitudes: DataFrame
    products: DataFrame
    displacements: DataFrame
    edges: DataFrame
    counts: DataFrame


def with_derived(slices: DataFrame, min_density: float = FLOOR) -> DataFrame:
    """The slice with all 28 fields; absent ones are NaN."""
    return elsasser(alfven(filled(slices), min_density))


def framed_samples(grid: DataFrame, samples: DataFrame, rows: int, columns: int, axis: int = 3, width: int = 2, channels: list[str] | None = None, extra: tuple[str, ...] = (), bins: Binning = Binning()) -> DataFrame:
    """Samples with increments, frame and angle bins. Only the fields that ``channels`` need are joined."""
    vectors = vectors_of(channels or [*MAGNITUDES, *PRODUCTS])
    keep = [*extra, "disp_id", "di", "dj", "r", "ell_bin"]
    gathered = gather(samples, grid, vector_columns(vectors), rows, columns, width)
    return angle_bins(local_frame(increments(gathered, vectors, keep, width), axis, keep), bins.theta, bins.phi)


def edge_table(df: DataFrame, ell: list[float], bins: Binning = Binning()) -> DataFrame:
    kinds = {"ell": ell, "theta": bins.theta, "phi": bins.phi, "sf": bins.sf, "product": bins.product}
    return df.sparkSession.createDataFrame([(k, i, float(e)) for k, edges in kinds.items() for i, e in enumerate(edges)], "kind string, idx int, edge double")


def check_fields(slices: DataFrame) -> None:
    """An error where a field that every analysis needs is absent or no number."""
    kinds = dict(slices.dtypes)
    missing = [c for c in vector_columns(["rho", "v", "b"]) if c not in kinds]
    if missing:
        raise ValueError(f"the slice lacks {', '.join(missing)}")
    wrong = [c for c in vector_columns(["rho", "v", "b"]) if kinds[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kinds[c].startswith("decimal")]
    if wrong:
        raise TypeError(f"{', '.join(wrong)} hold no numbers")


def analyse_slices(
    slices: DataFrame, rows: int, columns: int, *, n_displacements: int = 1000, n_ell_bins: int = 128, n_random_subsamples: int = 1000, stencil_width: int = 2, axis: int = 3, seed: int = 0,
    bins: Binning = Binning(), min_density: float = FLOOR, displacements: DataFrame | None = None, ell: list[float] | None = None, slice_ids: list[str] | None = None,
) -> Result:
    """Both histogram families of a table of slices (slice_id, j, i, fields) of one shape, or of one slice without slice_id, in one job.

    Counts are summed over slices. ``seed`` draws the displacements and the sample positions; ``displacements(disp_id, di,
    dj)`` and the edges ``ell`` of the scale bins may be given instead. ``slice_ids`` saves a scan for the slices there are.
    """
    check_fields(slices)
    ell = ell or scale_edges(1, largest_scale(rows, stencil_width), n_ell_bins)
    disp = displacements if displacements is not None else displacement_list(slices.sparkSession, ell, n_displacements, seed)
    scaled, extra = with_scale(disp, ell), ("slice_id",) if "slice_id" in slices.columns else ()
    if extra:
        there = slices.select("slice_id").distinct() if slice_ids is None else _ids(slices, slice_ids)
        scaled = there.crossJoin(F.broadcast(scaled))  # the displacement list is bounded by its request
    samples = permuted_samples(scaled, rows, columns, n_random_subsamples, seed)
    framed = framed_samples(with_derived(slices, min_density), samples, rows, columns, axis, stencil_width, extra=extra, bins=bins)
    parts = magnitude_histogram(framed, edges=bins.sf), product_histogram(framed, edges=bins.product)
    return Result(*parts, disp, edge_table(slices, ell, bins), all_histograms(framed, bins.sf, bins.product))


def _ids(df: DataFrame, slice_ids: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(s,) for s in slice_ids], "slice_id string")


def analyse_slice(slices: DataFrame, *, axis: int = 1, **options: object) -> Result:
    """As :func:`analyse_slices` for one slice table (j, i, fields), whose shape is found and checked."""
    check_fields(slices)
    return analyse_slices(slices.drop("slice_id"), *check_dense(slices), axis=axis, **options)


def simple_increments(slices: DataFrame, **options: object) -> DataFrame:
    """Raw increments of the ``first`` shortest displacements of one slice; options as of :func:`simple_increments_of`."""
    rows, columns = check_dense(slices)
    return simple_increments_of(slices.drop("slice_id"), rows, columns, **options)


def simple_increments_of(
    slices: DataFrame, rows: int, columns: int, slice_ids: list[str] | None = None, *, n_displacements: int = 1000, n_ell_bins: int = 128, n_samples: int = 100, first: int = 20, seed: int = 0, displacements: DataFrame | None = None
) -> DataFrame:
    """Raw increments (slice_id, disp_id, r, dv, db, drho) of the ``first`` shortest displacements of slices of one shape, or of one without slice_id."""
    ell = scale_edges(1, rows // 4, n_ell_bins)
    disp = displacements if displacements is not None else displacement_list(slices.sparkSession, ell, n_displacements, seed)
    r = F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double"))
    few = disp.where(F.col("disp_id") < first).withColumn("r", r)
    if slice_ids is not None:
        few = _ids(slices, slice_ids).crossJoin(F.broadcast(few))  # the displacement list is bounded by its request
    samples = permuted_samples(few, rows, columns, n_samples, seed)
    return raw_increments(gather(samples, slices, vector_columns(["rho", "v", "b"]), rows, columns))
