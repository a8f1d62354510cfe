"""Runs from files to stored results (API-4..8, SNK-2..7, SRC-8, SRC-13, SRC-14).

``python -m incrementa.plans.jobs batch|simple|show|list|demo|pipeline ...`` with the flags of a run. Every result is a folder
of Parquet datasets with one row of metadata; lists of slices are text files of one path a line.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from incrementa.functions.morton import slice_index
from incrementa.functions.physics import quality_metrics
from incrementa.operators.channels import MAGNITUDES, PRODUCTS
from incrementa.operators.displacements import largest_scale, scale_edges
from incrementa.operators.statistics import binned_means, marginal, moments, plot_scales
from incrementa.operators.volume import LAYOUT, PRIMITIVES, check_axis, extract_slice
from incrementa.plans.analysis import Result, analyse_slices, simple_increments_of
from incrementa.sources.config import RunConfig, Settings, parse_run, read_result, write_result, write_slice_list
from incrementa.sources.slices import check_dense, check_stride, listed_paths, load_slice, parse_name, read_npz, shapes, slice_name

#: fixed values: how the composed job analyses its three slices
SIMPLE = "simple_sf"
RAW_SCHEMA = "disp_id int, r double, dv double, db double, drho double"
PIPELINE = {"stride": 2, "n_displacements": 500, "n_ell_bins": 32, "n_random_subsamples": 500}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discovered(spark: SparkSession, folder: str, pattern: str = "*.npz") -> list[str]:
    """Paths in a folder that match, sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or ())


def list_slices(spark: SparkSession, folder: str, path: str, pattern: str = "*.npz") -> list[str]:
    """Write the list of a folder's slices to a text file; an error where there is none."""
    found = discovered(spark, folder, pattern)
    if not found:
        raise FileNotFoundError(f"{folder}/{pattern}")
    write_slice_list(spark, found, path)
    return found


def slice_paths(spark: SparkSession, run: RunConfig) -> list[str]:
    """The run's slice, or those of its list in the list's order of names; the list is as long as a run has files."""
    if run.file_name is not None:
        return [run.file_name]
    found = sorted(r["path"] for r in listed_paths(spark.read.text(run.slice_list)).collect())
    if not found:
        raise ValueError(f"{run.slice_list} names no slice")
    return found


def read_slices(spark: SparkSession, paths: list[str], stride: int = 1, capture: bool = False) -> tuple[DataFrame, dict[str, tuple[int, int]], dict[str, str]]:
    """(slices (slice_id, j, i, fields), strided; rows and columns by path; what is wrong by path) of NPZ files and Parquet folders.

    All are read by one scan a format and checked by one aggregate; nothing loops over slices but the list itself. A
    slice that is wrong is an error, or with ``capture`` is told of and left out.
    """
    names = {PurePosixPath(p).name: p for p in paths}
    if len(names) < len(paths):
        raise ValueError("slices of a run must have different names")
    archives = [p for p in paths if p.endswith(".npz")]
    folders = [p for p in paths if not p.endswith(".npz")]
    wrong = {p: f"FileNotFoundError: {p}" for p in folders if not exists(spark, p)}
    folders = [p for p in folders if p not in wrong]
    cells, grids = [], []
    if archives:
        cells.append(read_npz(spark, archives, [], capture=True).select("slice_id", "j", "i", "error"))
        grids.append(load_slice(read_npz(spark, archives, capture=capture).drop("error"), stride))
    if folders:
        stored = spark.read.option("mergeSchema", "true").parquet(*folders)
        stored = stored.withColumn("slice_id", F.element_at(F.split(F.url_decode("_metadata.file_path"), "/"), -2))
        cells.append(stored.select("slice_id", "j", "i", F.lit(None).cast("string").alias("error")))
        # a field that another slice has and this one lacks
        grids.append(load_slice(stored.fillna(float("nan"), [c for c, t in stored.dtypes if t in ("double", "float")]), stride))
    found = shapes(reduce(DataFrame.unionByName, cells)).collect() if cells else []  # a row a slice of the list
    sizes = {names[r.slice_id]: (r.rows, r.columns) for r in found}
    wrong |= {names[r.slice_id]: r.problem for r in found if r.problem}
    wrong |= {p: "ValueError: the slice is empty" for p in folders if p not in sizes}
    for p in sizes.keys() - wrong.keys():
        try:
            check_stride(stride, *sizes[p])
        except ValueError as error:
            wrong[p] = f"ValueError: {error}"
    if wrong and not capture:
        path, text = sorted(wrong.items())[0]
        raise (FileNotFoundError if text.startswith("FileNotFoundError") else ValueError)(f"{path}: {text}")
    good = [PurePosixPath(p).name for p in paths if p not in wrong]
    every = reduce(DataFrame.unionByName, grids).where(F.col("slice_id").isin(good)) if good else None
    return every, {p: tuple(-(-n // stride) for n in sizes[p]) for p in paths if p not in wrong}, wrong


def read_slice(spark: SparkSession, path: str, stride: int = 1) -> tuple[DataFrame, int, int]:
    """(slice, rows, columns): an NPZ file or a Parquet folder, strided; the stride must not pass the lesser dimension."""
    grid, sizes, _ = read_slices(spark, [path], stride)
    return grid.drop("slice_id"), *sizes[path]


def scales_of(rows: int, run: RunConfig) -> list[float]:
    return scale_edges(1, largest_scale(rows, run.stencil_width), run.n_ell_bins)


def store_result(spark: SparkSession, result: Result, ell: list[float], settings: Settings, meta: dict[str, object], out: str) -> None:
    """Both histograms, edges, displacements, the catalogue of channels, mean curves and metadata under ``out``."""
    counts = result.counts
    parts = {"counts": counts, "edges": result.edges, "displacements": result.displacements}
    parts["channels"] = spark.createDataFrame([(c, "magnitude" if c in MAGNITUDES else "product", k) for k, c in enumerate([*MAGNITUDES, *PRODUCTS])], "name string, family string, idx int")
    write_result(parts, meta, out)
    stored = read_result(spark, out, "counts")
    curves = moments(magnitudes_of(stored), ell, settings.binning.sf)
    write_result({"curves": curves.select("channel", "ell_bin", "ell_center", "sf_p", "count")}, meta, out)


def magnitudes_of(counts: DataFrame) -> DataFrame:
    """(channel, ell_bin, theta_bin, phi_bin, sf_bin, count) of stored counts."""
    return counts.where(F.col("channel").isin(list(MAGNITUDES))).withColumnRenamed("value_bin", "sf_bin")


def products_of(counts: DataFrame) -> DataFrame:
    """(channel, ell_bin, product_bin, count) of stored counts."""
    return counts.where(F.col("channel").isin(list(PRODUCTS))).withColumnRenamed("value_bin", "product_bin").drop("theta_bin", "phi_bin")


def run_batch(spark: SparkSession, run: RunConfig, settings: Settings | None = None, out: str | None = None, *, seed: int = 0, displacements: DataFrame | None = None, ell: list[float] | None = None) -> str:
    """All slices of a run analysed in one job, counts summed, stored with metadata; returns the folder.

    Slices share shape and axis; the axis is read from the file names.
    """
    settings = settings or Settings()
    paths = slice_paths(spark, run)
    named = [parse_name(PurePosixPath(p).name) for p in paths]
    grid, sizes, _ = read_slices(spark, paths, run.stride)
    if len({(*sizes[p], axis) for p, (axis, _) in zip(paths, named)}) > 1:
        raise ValueError("slices of a run must have the same shape and axis")
    rows, columns = sizes[paths[0]]
    ids = [PurePosixPath(p).name for p in paths]
    ell, seen = ell or scales_of(rows, run), Observation("quality")
    watched = grid.observe(seen, *quality_metrics())
    result = analyse_slices(
        watched if len(paths) > 1 else watched.drop("slice_id"), rows, columns, n_displacements=run.n_disp_total, n_ell_bins=run.n_ell_bins, n_random_subsamples=run.n_random_subsamples,
        stencil_width=run.stencil_width, axis=named[0][0], seed=seed, bins=settings.binning, min_density=settings.min_density, displacements=displacements, ell=ell, slice_ids=ids,
    )
    meta = {"n_slices": len(paths), "stride": run.stride, "stencil_width": run.stencil_width, "N_random_subsamples": run.n_random_subsamples, "axis": named[0][0], "beta": named[0][1]}
    out = out or f"{settings.directory}/sf_results_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    store_result(spark, result, ell, settings, meta, out)
    # gathered while the counts were written
    quality = spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in seen.get.items()], "name string, value double")
    write_result({"quality": quality.coalesce(1)}, meta, out)
    return out


def run_simple(spark: SparkSession, run: RunConfig, out: str, *, first: int = 20, seed: int = 0, displacements: DataFrame | None = None) -> dict[str, str]:
    """Raw increments of the ``first`` shortest displacements of every slice, stored by slice in one job; a slice that is wrong leaves the others be.

    Returns what went wrong, by path.
    """
    failed, named = {}, {}
    for path in slice_paths(spark, run):
        try:
            named[path] = parse_name(PurePosixPath(path).name)
        except ValueError as wrong:
            failed[path] = f"ValueError: {wrong}"
    grid, sizes, wrong = read_slices(spark, list(named), run.stride, capture=True) if named else (None, {}, {})
    failed |= wrong
    parts = []
    for shape in sorted(set(sizes.values())):
        ids = [PurePosixPath(p).name for p in sizes if sizes[p] == shape]
        alike = grid.where(F.col("slice_id").isin(ids))
        try:
            parts.append(simple_increments_of(alike, *shape, ids, n_displacements=run.n_disp_total, n_ell_bins=run.n_ell_bins, n_samples=run.n_random_subsamples, first=first, seed=seed, displacements=displacements))
        except ValueError as error:  # a shape that admits no scales or too few samples
            failed |= {p: f"ValueError: {error}" for p in sizes if sizes[p] == shape}
    if not parts:
        return failed
    raw = reduce(DataFrame.unionByName, parts)
    raw.withColumnRenamed("slice_id", "slice").write.mode("overwrite").partitionBy("slice").parquet(f"{out}/{SIMPLE}/increments")
    when = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%S}"
    meta = [(PurePosixPath(p).name, {"axis": str(named[p][0]), "beta": str(named[p][1]), "stride": str(run.stride), "date": when}) for p in sizes if p not in failed]
    spark.createDataFrame(meta, "slice string, meta map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{out}/{SIMPLE}/run_meta")
    return failed


def read_simple(spark: SparkSession, out: str, name: str | None = None) -> DataFrame:
    """Stored raw increments: of the named slice, or of the first by name; only its folder is read."""
    path = f"{out}/{SIMPLE}/increments"
    stored = discovered(spark, path, "slice=*") if exists(spark, path) else []
    found = sorted(unquote(p.rsplit("slice=", 1)[1]) for p in stored)
    found = [n for n in found if name is None or PurePosixPath(n).stem == PurePosixPath(name).stem or n == name]
    if not found:
        raise FileNotFoundError(f"{path}: {name or 'no slice'}")
    return spark.read.schema(f"{RAW_SCHEMA}, slice string").parquet(path).where(F.col("slice") == found[0]).drop("slice")


def simple_curves(spark: SparkSession, out: str, name: str | None = None) -> DataFrame:
    """Mean increments by scale of a stored simple result: what its plot shows."""
    raw = read_simple(spark, out, name)
    return binned_means(raw, plot_scales(raw))


def fingerprint(volume: DataFrame, axis: int, value: float, n: int) -> str:
    """Key of a slice by what it is made of: the cells of its plane and the two beside it, whatever their order, the axis, the place and the size."""
    check_axis(axis)
    normal, index = LAYOUT[axis][0], slice_index(value, n)
    near = volume.where(F.col(normal).isin(sorted({(index + d) % n for d in (-1, 0, 1)})))
    cell = [F.col(c).cast("int") for c in "kji"] + [F.col(f).cast("double") for f in PRIMITIVES]
    got = near.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), *cell).cast("decimal(38,0)")) for seed in (1, 2))).first()
    return hashlib.sha256(repr((axis, index, n, *map(str, got))).encode()).hexdigest()[:32]


def moved_once(spark: SparkSession, source: str, path: str) -> bool:
    """Move a folder to where nothing is yet, in one step; False where another writer was first, whose folder stays."""
    jvm = spark._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, path))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(a, b, none)
        return True
    except Exception:
        if not exists(spark, f"{path}/_SUCCESS"):
            raise
        files.delete(a, True)
        return False


def extracted(spark: SparkSession, volume: DataFrame, axis: int, value: float, n: int, folder: str, sim: str = "run", file_number: int = 0) -> DataFrame:
    """The stored slice, computed and written only where none of the same content is there.

    It lies under its name in a folder named by its fingerprint; it is written aside and moved there whole, so that of
    writers at the same time one wins and none is seen half done.
    """
    home = f"{folder}/{slice_name(sim, axis, value, file_number)}"
    path = f"{home}/key={fingerprint(volume, axis, value, n)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        aside = f"{home}/_writing-{uuid.uuid4().hex}"
        extract_slice(volume, axis, value, n).write.parquet(aside)
        moved_once(spark, aside, path)
    return spark.read.parquet(path)


def run_pipeline(spark: SparkSession, volume: DataFrame, n: int, folder: str, *, seed: int = 0, settings: Settings | None = None, displacements: DataFrame | None = None, ell: list[float] | None = None, **options: int) -> DataFrame:
    """Slices normal to all three axes through the middle, analysed and stored; returns counts by axis, channel, scale and value bin."""
    settings, options = settings or Settings(), PIPELINE | options
    stride = options.pop("stride")

    def sliced(axis: int) -> DataFrame:
        grid = load_slice(extracted(spark, volume, axis, 0.0, n, f"{folder}/slices"), stride)
        rows, columns = check_dense(grid)
        edges = ell or scale_edges(1, largest_scale(rows, 2), options["n_ell_bins"])
        few = options | {"n_random_subsamples": min(options["n_random_subsamples"], rows * columns)}
        result = analyse_slices(grid, rows, columns, axis=axis, seed=seed, bins=settings.binning, min_density=settings.min_density, displacements=displacements, ell=edges, **few)
        out = f"{folder}/sf_results_axis{axis}"
        store_result(spark, result, edges, settings, {"axis": axis, "stride": stride, "stencil_width": 2, "N_random_subsamples": few["n_random_subsamples"], "n_slices": 1}, out)
        return marginal(read_result(spark, out, "counts"), "ell_bin", "value_bin").withColumn("axis", F.lit(axis))

    # the three don't depend on each other: their jobs share the cluster
    with ThreadPoolExecutor(3) as pool:
        return reduce(DataFrame.unionByName, pool.map(sliced, (1, 2, 3)))


def run_demo(spark: SparkSession, folder: str, out: str, *, seed: int = 0, pattern: str = "*.npz", **options: int) -> dict[str, str]:
    """All steps over a folder of slices: the list, raw increments of every slice, a batch run of each axis and shape, curves of the first slice.

    Returns where each lies, by step, and ``failed:<path>`` for slices that were left out. ``options`` are a run's numbers.
    """
    places = {"list": f"{out}/slices.txt", "simple": f"{out}/simple", "curves": f"{out}/curves"}
    list_slices(spark, folder, places["list"], pattern)
    run = replace(RunConfig(slice_list=places["list"]), **options)
    failed = run_simple(spark, run, places["simple"], seed=seed)
    good = [p for p in slice_paths(spark, run) if p not in failed]
    _, sizes, _ = read_slices(spark, good, run.stride, capture=True)
    alike: dict[tuple, list[str]] = {}
    for p in good:
        alike.setdefault((parse_name(PurePosixPath(p).name)[0], *sizes[p]), []).append(p)
    for (axis, rows, columns), paths in sorted(alike.items()):
        part = f"{out}/slices_axis{axis}_{rows}x{columns}.txt"
        write_slice_list(spark, paths, part)
        few = min(run.n_random_subsamples, rows * columns)
        places[f"batch_axis{axis}_{rows}x{columns}"] = run_batch(spark, replace(run, slice_list=part, n_random_subsamples=few), out=f"{out}/batch_axis{axis}_{rows}x{columns}", seed=seed)
    simple_curves(spark, places["simple"]).write.mode("overwrite").parquet(places["curves"])
    return places | {f"failed:{p}": why for p, why in failed.items()}


def main(argv: list[str] | None = None) -> None:
    """batch: analyse a slice or a list. simple: raw increments. show: curves of a simple result. list: write a folder's list. demo: all of these over a folder. pipeline: a volume's three slices."""
    command, *rest = sys.argv[1:] if argv is None else argv
    spark = SparkSession.builder.getOrCreate()
    if command == "list":
        folder, path = rest
        print("\n".join(list_slices(spark, folder, path)))
    elif command == "show":
        simple_curves(spark, *rest).orderBy("r_bin").show(100, False)
    elif command == "demo":
        folder, out = rest
        for step, where in run_demo(spark, folder, out).items():
            print(f"{step}: {where}")
    elif command == "pipeline":
        path, n, folder = rest
        run_pipeline(spark, spark.read.parquet(path), int(n), folder).groupBy("axis", "channel").agg(F.sum("count").alias("count")).orderBy("axis", "channel").show(100, False)
    else:
        run, settings = parse_run(rest)
        if command == "batch":
            print(run_batch(spark, run, settings))
        elif command == "simple":
            for path, why in run_simple(spark, run, settings.directory).items():
                print(f"{path}: {why}", file=sys.stderr)
        else:
            raise SystemExit(f"unknown command {command}")


if __name__ == "__main__":
    main()
