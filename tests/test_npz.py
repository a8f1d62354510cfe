"""NPZ slices read in bands, against numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from incrementa.sources import slices as sl
from incrementa.sources.npz import NpzReader, bands, members
from pyspark.sql.types import StructType


def table(df, *fields):
    got = df.select("j", "i", *fields).toPandas().sort_values(["j", "i"])
    rows, columns = got["j"].max() + 1, got["i"].max() + 1
    return [got[f].to_numpy().reshape(rows, columns) for f in fields]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    rng, folder = np.random.default_rng(4), tmp_path_factory.mktemp("npz")
    dens, velx = rng.normal(size=(37, 23)), rng.integers(-9, 9, (37, 23)).astype(np.int16)
    np.savez(folder / "stored.npz", dens=dens, velx=velx, note=np.array(["text"]))
    np.savez(folder / "turned.npz", dens=np.asfortranarray(dens), velx=velx)
    np.savez_compressed(folder / "packed.npz", dens=dens, velx=np.asfortranarray(velx))
    return folder, dens, velx


@pytest.mark.parametrize("name", ["stored", "turned", "packed"])
@pytest.mark.parametrize("band_bytes", [1, 1000, 1 << 26])
def test_bands_against_numpy(spark, made, name, band_bytes):
    folder, dens, velx = made
    df = sl.read_npz(spark, f"{folder}/{name}.npz", ["dens", "velx", "bcc1"], band_bytes=band_bytes)
    got = table(df, "dens", "velx", "bcc1")
    assert (got[0] == dens).all() and (got[1] == velx).all() and np.isnan(got[2]).all()
    tasks = df.rdd.getNumPartitions()
    assert tasks == (1 if name == "packed" else {1: 37, 1000: 10, 1 << 26: 1}[band_bytes])
    assert {r[0] for r in df.select("slice_id").distinct().collect()} == {f"{name}.npz"}


def test_only_the_asked_fields_are_read(made):
    folder, dens, _ = made
    (band,) = bands(str(folder / "stored.npz"), ["dens"], tuple(sl.FIELDS), 1 << 20)
    assert [k for k, _ in band.members] == ["dens"]
    at = members(str(folder / "stored.npz"))["dens"]
    raw = (folder / "stored.npz").read_bytes()
    assert (np.frombuffer(raw[at.at : at.at + dens.nbytes]).reshape(dens.shape) == dens).all()


def test_only_the_asked_rows_are_read(spark, made):
    folder, dens, velx = made
    for name in ("stored", "turned", "packed"):
        df = sl.read_npz(spark, f"{folder}/{name}.npz", ["dens", "velx"], rows=(20, 25), band_bytes=23 * 8 * 2)
        got = df.toPandas().sort_values(["j", "i"])
        assert (got["dens"].to_numpy().reshape(5, 23) == dens[20:25]).all() and (got["velx"].to_numpy().reshape(5, 23) == velx[20:25]).all() and got["j"].min() == 20
    assert sl.read_npz(spark, str(folder), ["dens"], rows=(30, None), band_bytes=1).rdd.getNumPartitions() == 7 + 7 + 1
    assert sl.read_npz(spark, str(folder), ["dens"], rows=(40, None)).count() == 0


def test_one_bad_file_among_many(spark, tmp_path):
    for k in range(40):
        np.savez(tmp_path / f"slice_{k:02d}.npz", dens=np.full((4, 4), float(k)))
    (tmp_path / "slice_07.npz").write_bytes(b"no archive" * 99)
    np.savez(tmp_path / "slice_08.npz", dens=np.ones((4, 4)), velx=np.ones((2, 2)))
    np.savez(tmp_path / "slice_09.npz", dens=np.array([[{}]], dtype=object), allow_pickle=True)
    df = sl.read_npz(spark, str(tmp_path), ["dens"], capture=True)
    wrong = {r.slice_id: r.error for r in df.where("error is not null").collect()}
    assert sorted(wrong) == ["slice_07.npz", "slice_08.npz", "slice_09.npz"]
    assert wrong["slice_07.npz"].startswith("BadZipFile") and "different shapes" in wrong["slice_08.npz"] and "no numbers" in wrong["slice_09.npz"]
    assert df.where("error is null").groupBy("slice_id").count().where("count = 16").count() == 37
    found = {r.slice_id: r.problem for r in sl.shapes(df).collect()}
    assert {k: v for k, v in found.items() if v} == wrong and len(found) == 40
    with pytest.raises(Exception, match="File is not a zip file"):
        sl.read_npz(spark, str(tmp_path), ["dens"]).count()


def test_shapes_name_what_is_missing(spark):
    rows = [("a", j, i) for j in range(3) for i in range(4)]
    rows += [("b", j, i) for j in range(3) for i in range(4) if (j, i) != (1, 2)]
    rows += [("c", 0, 0), ("c", 0, 0), ("c", 1, 1), ("c", 1, 1), ("d", 1, 1), ("d", 1, 2), ("d", 2, 1), ("d", 2, 2)]
    got = {r.slice_id: r for r in sl.shapes(spark.createDataFrame(rows, "slice_id string, j int, i int")).collect()}
    assert (got["a"].rows, got["a"].columns, got["a"].problem) == (3, 4, None)
    assert got["b"].problem == "11 rows do not fill 3 x 4 cells" and got["c"].problem and got["d"].problem


def test_a_slice_larger_than_a_binary_file(spark, tmp_path):
    """4096 x 4097 doubles times 20 fields would not fit; two sparse fields of over 2 GB in all do."""
    rows, columns = 16400, 8200
    path = tmp_path / "large.npz"
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name in ("dens", "velx"):
            with z.open(f"{name}.npy", "w", force_zip64=True) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (rows, columns)})
                for a in range(0, rows, 820):
                    f.write((np.arange(a, a + 820, dtype="<f8")[:, None] + np.zeros(columns)).tobytes())
    assert path.stat().st_size > 2 << 30
    assert sl.read_npz(spark, str(path), ["velx"]).rdd.getNumPartitions() == 17
    some = sl.read_npz(spark, str(path), ["velx"], rows=(16000, 16010)).agg(F.min("velx"), F.max("velx"), F.count("*")).first()
    assert tuple(some) == (16000.0, 16009.0, 10 * columns)


def test_reader_options():
    schema = StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("j", "integer"), ("dens", "double"))]})
    reader = NpzReader(schema, {"paths": json.dumps([])})
    assert reader.partitions()[0].bands[0].stop == 0 and not reader.capture
