"""Slice tables (SRC-1..9, SNK-1): canonical fields, stride, filling, file-name metadata."""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incrementa.sources.npz import BAND_BYTES, FORMAT, NpzSlices, opened

#: fixed values: stored names and canonical ones
FIELDS = {
    "dens": "rho", "velx": "v_x", "vely": "v_y", "velz": "v_z", "bcc1": "b_x", "bcc2": "b_y", "bcc3": "b_z",
    "vortx": "omega_x", "vorty": "omega_y", "vortz": "omega_z", "currx": "j_x", "curry": "j_y", "currz": "j_z",
    "curvx": "curv_x", "curvy": "curv_y", "curvz": "curv_z", "grad_rho_x": "grad_rho_x", "grad_rho_y": "grad_rho_y", "grad_rho_z": "grad_rho_z",
}
#: fixed values: axis and beta in a slice's file name
NAME = r"slice_x([123])_.*?_beta([0-9]+(?:\.[0-9]+)?)"
#: fixed values: the extractor's own names
EXTRACTED = r"_axis([123])_slice(m?[0-9p]+)_file([0-9]+)"


def canonical(df: DataFrame) -> DataFrame:
    """Stored names to canonical ones; other columns but the coordinates are left out."""
    keep = [c for c in df.columns if c in FIELDS or c in ("slice_id", "j", "i")]
    return df.select(*keep).withColumnsRenamed({k: v for k, v in FIELDS.items() if k in keep})


def as_double(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c in FIELDS.values()})


def filled(df: DataFrame) -> DataFrame:
    """Adds the fields that are absent, as NaN."""
    return df.withColumns({c: F.lit(float("nan")) for c in FIELDS.values() if c not in df.columns})


def strided(df: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row and column, numbered anew."""
    check_stride(stride)
    if stride == 1:
        return df
    kept = df.where((F.col("j") % stride == 0) & (F.col("i") % stride == 0))
    return kept.withColumns({"j": (F.col("j") / stride).cast("int"), "i": (F.col("i") / stride).cast("int")})


def check_stride(stride: int, rows: int | None = None, columns: int | None = None) -> None:
    """An error where the stride is no positive whole number, or passes the lesser of the given dimensions."""
    if isinstance(stride, bool) or not isinstance(stride, int):
        raise TypeError("stride must be an integer")
    if stride < 1:
        raise ValueError("stride must be at least 1")
    if rows is not None and columns is not None and stride > min(rows, columns):
        raise ValueError(f"stride {stride} passes the lesser dimension of {rows} x {columns}")


def load_slice(df: DataFrame, stride: int = 1) -> DataFrame:
    """A stored slice table as the engine's: canonical, double, all 19 fields, strided."""
    if not any(c in FIELDS for c in df.columns):
        raise ValueError("no known field in the slice")
    return strided(filled(as_double(canonical(df))), stride)


def check_dense(df: DataFrame) -> tuple[int, int]:
    """(rows, columns) of a slice; an error if a cell is missing, doubled or if it is empty.

    Without a shuffle: coordinates that count as many cells as there are, and whose sums and sums of squares,
    plain and mixed, are those of every cell once, hold each cell once but for contrived tables.
    """
    j, i = (F.col(c).cast("decimal(38,0)") for c in "ji")
    n, rows, cols, *found = df.agg(F.count("*"), F.max("j") + 1, F.max("i") + 1, F.min("j"), F.min("i"), *(F.sum(x) for x in (j, i, j * j, i * i, j * i))).first()
    if not n:
        raise ValueError("the slice is empty")
    whole = lambda m: m * (m - 1) // 2
    squares = lambda m: m * (m - 1) * (2 * m - 1) // 6
    want = [0, 0, whole(rows) * cols, whole(cols) * rows, squares(rows) * cols, squares(cols) * rows, whole(rows) * whole(cols)]
    if n != rows * cols or [int(x) for x in found] != want:
        raise ValueError(f"{n} rows do not fill {rows} x {cols} cells")
    return rows, cols


def shapes(slices: DataFrame) -> DataFrame:
    """(slice_id, rows, columns, problem) of every slice of a table (slice_id, j, i[, error]), by one aggregate.

    ``problem`` is null for a slice whose cells are there once each; see :func:`check_dense`.
    """
    j, i = (F.col(c).cast("decimal(38,0)") for c in "ji")
    told = F.max("error") if "error" in slices.columns else F.lit(None).cast("string")
    got = slices.groupBy("slice_id").agg(
        F.count("j").alias("n"), (F.max("j") + 1).cast("long").alias("rows"), (F.max("i") + 1).cast("long").alias("columns"), F.min("j").alias("j0"), F.min("i").alias("i0"),
        *(F.sum(x).alias(c) for c, x in {"sj": j, "si": i, "sjj": j * j, "sii": i * i, "sji": j * i}.items()), told.alias("told"),
    )
    m, n = (F.col(c).cast("decimal(12,0)") for c in ("rows", "columns"))
    whole = lambda m: m * (m - 1) / 2
    want = (F.col("n") == m * n) & (F.col("j0") == 0) & (F.col("i0") == 0)
    want &= (F.col("sj") == whole(m) * n) & (F.col("si") == whole(n) * m) & (F.col("sji") == whole(m) * whole(n))
    want &= (F.col("sjj") == m * (m - 1) * (2 * m - 1) / 6 * n) & (F.col("sii") == n * (n - 1) * (2 * n - 1) / 6 * m)
    wrong = F.when(F.col("n") == 0, F.lit("the slice is empty")).when(~want, F.format_string("%d rows do not fill %d x %d cells", "n", "rows", "columns"))
    return got.select("slice_id", "rows", "columns", F.coalesce("told", wrong).alias("problem"))


def metadata(path: Column) -> tuple[Column, Column]:
    """(axis, beta) from a file name, null where it does not tell."""
    pattern = f"(?i){NAME}"
    return _number(F.regexp_extract(path, pattern, 1), "int"), _number(F.regexp_extract(path, pattern, 2), "double")


def _number(text: Column, kind: str) -> Column:
    return F.when(text != "", text.try_cast(kind))


def parse_name(path: str | Path) -> tuple[int, float]:
    """(axis, beta) from a file name; ValueError where it does not tell."""
    if not isinstance(path, (str, Path)):
        raise TypeError("a path is text")
    found = re.search(NAME, Path(path).name, re.IGNORECASE)
    if not found:
        raise ValueError(f"no axis and beta in {Path(path).name}")
    return int(found[1]), float(found[2])


def axis_by_name(path: Column) -> Column:
    """Axis guessed from 'axis1' or 'axis2' in a path, else 3."""
    return F.when(path.contains("axis1"), 1).when(path.contains("axis2"), 2).otherwise(3)


def listed_paths(lines: DataFrame) -> DataFrame:
    """(path) of a text table of one path a line, blanks stripped, empty lines left out."""
    return lines.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("path")).where("path <> ''")


def value_code(value: Column) -> Column:
    """A slice position in a file name: eight decimals without trailing zeros, '-' as m, '.' as p, nothing as 0."""
    text = F.format_string("%.8f", value)
    short = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    coded = F.translate(short, "-.", "mp")
    return F.when(coded == "", "0").otherwise(coded)


def slice_name(sim: str, axis: int, value: float, file_number: int) -> str:
    short = f"{value:.8f}".rstrip("0").rstrip(".").replace("-", "m").replace(".", "p") or "0"
    return f"{sim}_axis{axis}_slice{short}_file{file_number:04d}"


def latest_files(files: DataFrame, file_number: int | None = None) -> DataFrame:
    """(rank, path) of a listing (rank, path): each rank's file at a place in name order, or its last; ranks without it are left out."""
    from pyspark.sql import Window as W

    if file_number is None:
        return files.groupBy("rank").agg(F.max("path").alias("path"))
    if file_number < 0:
        raise ValueError("file_number must not be negative")
    place = F.row_number().over(W.partitionBy("rank").orderBy("path")) - 1
    return files.withColumn("place", place).where(F.col("place") == file_number).select("rank", "path")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package even where only the driver's path has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def npz_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The NPZ files that paths, patterns and folders name, sorted; a name without a pattern stays even where nothing is there."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = store.globStatus(at) or ()
        for f in found:
            inside = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "*.npz")) if f.isDirectory() else [f]
            out += [x.getPath().toString() for x in inside]
        if not found and not re.search(r"[*?\[{]", path):
            out.append(path)
    return sorted(out)


def read_npz(spark: SparkSession, paths: str | list[str], fields: list[str] | None = None, *, rows: tuple[int, int | None] = (0, None), band_bytes: int = BAND_BYTES, capture: bool = False) -> DataFrame:
    """(slice_id, j, i, fields) of NPZ slices, in bands of rows of about ``band_bytes`` a task; only ``fields`` and ``rows`` (first, stop) are read.

    Only arrays are loaded, never pickled objects; a field absent from a file is NaN in its rows. With ``capture`` a
    file that can't be read is a row with its name and ``error``, all else null, and the column is null elsewhere. Files in
    a store that only Spark reads come as binary files, unpacked whole.
    """
    fields = list(FIELDS) if fields is None else fields
    files = npz_files(spark, paths)
    try:
        for f in files[:1]:
            opened(f).close()
    except FileNotFoundError:
        pass  # told of by the reader
    except (OSError, pa.ArrowInvalid, NotImplementedError):
        whole = read_npz_whole(spark, files).select("slice_id", "j", "i", *fields)
        return whole.where(F.col("j").between(rows[0], (rows[1] or 1 << 31) - 1))
    importable(spark)
    spark.dataSource.register(NpzSlices)
    schema = "slice_id string, j int, i int" + "".join(f", {c} double" for c in fields) + ", error string" * capture
    return spark.read.format(FORMAT).schema(schema).options(paths=json.dumps(files), known=json.dumps(list(FIELDS)), rows=json.dumps(rows), band_bytes=band_bytes).load()


def read_npz_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(slice_id, j, i, fields) of NPZ slices, read by Spark as binary files and unpacked a file at a time; files under 2 GB."""
    import numpy as np

    schema = "slice_id string, j int, i int, " + ", ".join(f"{c} double" for c in FIELDS)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches:
            for path, content in zip(frame.column("path").to_pylist(), frame.column("content").to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    arrays = {k: z[k].astype(float) for k in FIELDS if k in z.files}
                shapes = {a.shape for a in arrays.values()}
                if len(shapes) != 1 or len(next(iter(shapes))) != 2:
                    raise ValueError(f"{path}: fields are absent, not two-dimensional or of different shapes")
                rows, cols = shapes.pop()
                for start in range(0, rows, 256):  # a few rows of the grid at a time
                    stop = min(rows, start + 256)
                    jj, ii = np.divmod(np.arange(start * cols, stop * cols, dtype=np.int64), cols)
                    cells = [arrays[k][start:stop].ravel() if k in arrays else np.full(len(jj), np.nan) for k in FIELDS]
                    yield pa.record_batch([pa.array([Path(path).name] * len(jj)), pa.array(jj.astype("int32")), pa.array(ii.astype("int32")), *map(pa.array, cells)], ["slice_id", "j", "i", *FIELDS])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(paths)
    return files.select("path", "content").mapInArrow(unpack, schema)


def check_npz_path(path: str | Path) -> Path:
    """A local NPZ path that exists; for files named by hand."""
    if not isinstance(path, (str, Path)):
        raise TypeError("a path is text")
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(p)
    if not p.is_file():
        raise ValueError(f"{p} is no file")
    if p.suffix != ".npz":
        raise ValueError("a slice file ends in .npz")
    return p
