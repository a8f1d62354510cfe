"""NPZ slices as a data source of Spark (SRC-1): bands of rows, by byte offset in the archive.

A file's central directory and array headers are read once, when the scan is planned. An array that is stored as it
is lies at a known offset, so a file of any size is cut into bands of rows of about ``band_bytes``, each read by a task
of its own with one seek a field. Only the fields of the asked-for schema are read, and only the asked-for rows. A compressed array can only be read from its start: such a file is one band, streamed
a few rows at a time.

With an ``error`` column in the schema, a file that can't be read is a row with its name and what is wrong, and the
others are read all the same; without one it fails the job. Objects are never unpickled.
"""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "npz_slices"
BAND_BYTES = 64 << 20
OPENING = 1 << 20
#: cells of a batch handed to Spark
BATCH_CELLS = 1 << 16
_KEYS = ("slice_id", "j", "i", "error")


@dataclass(frozen=True)
class Member:
    """An array of an archive; ``at`` is the offset of its first element, -1 where it is compressed."""

    name: str
    at: int
    dtype: str
    shape: tuple[int, ...]
    fortran: bool


@dataclass(frozen=True)
class Band(InputPartition):
    """Rows ``first`` to ``stop`` of a file's fields, or what is wrong with it."""

    path: str
    members: tuple[tuple[str, Member], ...] = ()
    first: int = 0
    stop: int = 0
    columns: int = 0
    error: str | None = None

    @property
    def slice_id(self) -> str:
        return PurePosixPath(self.path).name

    @property
    def size(self) -> int:
        """Bytes that reading it costs, counting the opening of a file as so many."""
        return OPENING + (self.stop - self.first) * self.columns * sum(np.dtype(m.dtype).itemsize for _, m in self.members)


@dataclass(frozen=True)
class Bands(InputPartition):
    """What a task reads: a band, or several small files."""

    bands: tuple[Band, ...]


def packed(found: list[Band], band_bytes: int) -> list[Bands]:
    """Bands in order, joined up to about ``band_bytes``."""
    out, held, size = [], [], 0
    for band in found:
        if held and size + band.size > band_bytes:
            out.append(Bands(tuple(held)))
            held, size = [], 0
        held.append(band)
        size += band.size
    return [*out, *([Bands(tuple(held))] if held else [])]


def opened(path: str) -> pa.NativeFile:
    """A file of a local path or URI, open at any place of it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def members(path: str) -> dict[str, Member]:
    """The arrays of an archive by name."""
    out = {}
    with opened(path) as file, zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with archive.open(info) as data:
                version = np.lib.format.read_magic(data)
                header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, fortran, dtype = header(data)
                skip = data.tell()
            at = -1
            if info.compress_type == zipfile.ZIP_STORED:
                file.seek(info.header_offset + 26)
                name, extra = struct.unpack("<HH", file.read(4))
                at = info.header_offset + 30 + name + extra + skip
            out[info.filename.removesuffix(".npy")] = Member(info.filename, at, dtype.str, shape, fortran)
    return out


def bands(path: str, fields: list[str], known: tuple[str, ...], band_bytes: int, first: int = 0, stop: int | None = None) -> list[Band]:
    """The bands of a file's rows ``first`` to ``stop``. All of its ``known`` fields must have one shape, those of ``fields`` be numbers."""
    found = {k: m for k, m in members(path).items() if k in known}
    shapes = {m.shape for m in found.values()}
    if len(shapes) != 1 or len(next(iter(shapes))) != 2:
        raise ValueError(f"{path}: fields are absent, not two-dimensional or of different shapes")
    rows, columns = shapes.pop()
    asked = tuple((k, found[k]) for k in fields if k in found)
    if wrong := [k for k, m in asked if np.dtype(m.dtype).kind not in "fiub"]:
        raise TypeError(f"{path}: {wrong[0]} holds no numbers")
    if any(m.at < 0 for _, m in asked):
        step = max(rows, 1)
    else:
        step = max(1, band_bytes // max(1, columns * sum(np.dtype(m.dtype).itemsize for _, m in asked) or columns * 8))
    first, stop = max(0, first), rows if stop is None else min(stop, rows)
    return [Band(path, asked, a, min(a + step, stop), columns) for a in range(first, stop, step)]


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.fields = [f.name for f in schema.fields if f.name not in _KEYS]
        self.capture = "error" in schema.fieldNames()
        self.paths = json.loads(options["paths"])
        self.known = tuple(json.loads(options.get("known", "[]"))) or tuple(self.fields)
        self.band_bytes = int(options.get("band_bytes", BAND_BYTES))
        self.rows = tuple(json.loads(options["rows"])) if "rows" in options else (0, None)

    def partitions(self) -> list[Bands]:
        def of(path: str) -> list[Band]:
            try:
                return bands(path, self.fields, self.known, self.band_bytes, *self.rows)
            except Exception as wrong:  # isolation of files is the feature
                if not self.capture:
                    raise
                return [Band(path, error=f"{type(wrong).__name__}: {wrong}")]

        with ThreadPoolExecutor(16) as pool:
            found = [b for some in pool.map(of, self.paths) for b in some]
        return packed(found or [Band("")], self.band_bytes)  # a scan has to have a partition

    def read(self, partition: Bands) -> Iterator[pa.RecordBatch]:
        for band in partition.bands:
            try:
                if band.error:
                    raise _Known(band.error)
                yield from self._cells(band)
            except Exception as wrong:
                if not self.capture:
                    raise
                text = str(wrong) if isinstance(wrong, _Known) else f"{type(wrong).__name__}: {wrong}"
                yield self._batch(1, {"slice_id": [band.slice_id], "error": [text]})

    def _batch(self, n: int, given: dict[str, object]) -> pa.RecordBatch:
        kinds = {"slice_id": pa.string(), "j": pa.int32(), "i": pa.int32(), "error": pa.string()}
        names = self.schema.fieldNames()
        columns = [pa.array(given[c], kinds.get(c, pa.float64())) if c in given else pa.nulls(n, kinds.get(c, pa.float64())) for c in names]
        return pa.record_batch(columns, names)

    def _cells(self, band: Band) -> Iterator[pa.RecordBatch]:
        if band.first >= band.stop:
            return
        step = max(1, BATCH_CELLS // max(1, band.columns))
        with opened(band.path) as file, zipfile.ZipFile(file) as archive:
            streams = {k: _Stream(archive, m) for k, m in band.members if m.at < 0}
            for s in streams.values():
                s.skip(band.first)
            for a in range(band.first, band.stop, step):
                b = min(a + step, band.stop)
                n = (b - a) * band.columns
                j, i = np.divmod(np.arange(a * band.columns, b * band.columns, dtype=np.int64), band.columns)
                given = {"slice_id": [band.slice_id] * n, "j": j.astype(np.int32), "i": i.astype(np.int32)}
                for k, m in band.members:
                    given[k] = streams[k].rows(a, b) if k in streams else stored_rows(file, m, a, b)
                absent = {k: np.full(n, np.nan) for k in self.fields if k not in given}
                yield self._batch(n, given | absent)


class _Known(Exception):
    """What was found wrong when the scan was planned."""


def stored_rows(file: pa.NativeFile, m: Member, a: int, b: int) -> np.ndarray:
    """Rows a to b of a stored array, as doubles."""
    kind, (rows, columns) = np.dtype(m.dtype), m.shape
    if not m.fortran:
        file.seek(m.at + a * columns * kind.itemsize)
        return np.frombuffer(file.read((b - a) * columns * kind.itemsize), kind).astype(float)
    out = np.empty((b - a, columns))
    for c in range(columns):
        file.seek(m.at + (c * rows + a) * kind.itemsize)
        out[:, c] = np.frombuffer(file.read((b - a) * kind.itemsize), kind)
    return out.ravel()


class _Stream:
    """Rows of a compressed array, asked for in order; one in column order has to be read whole."""

    def __init__(self, archive: zipfile.ZipFile, m: Member) -> None:
        self.m, self.kind = m, np.dtype(m.dtype)
        self.data = archive.open(m.name)
        version = np.lib.format.read_magic(self.data)
        (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(self.data)
        self.whole = np.frombuffer(self.data.read(), self.kind).reshape(m.shape, order="F") if m.fortran else None

    def skip(self, rows: int) -> None:
        left = 0 if self.whole is not None else rows * self.m.shape[1] * self.kind.itemsize
        while left:
            left -= len(self.data.read(min(left, 1 << 24)))

    def rows(self, a: int, b: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[a:b].astype(float).ravel()
        return np.frombuffer(self.data.read((b - a) * self.m.shape[1] * self.kind.itemsize), self.kind).astype(float)


class NpzSlices(DataSource):
    """``spark.read.format("npz_slices").schema(...).option("paths", json list)``; read through :func:`incrementa.sources.slices.read_npz`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(schema, self.options)
