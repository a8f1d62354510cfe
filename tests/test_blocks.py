"""Tiles with ghost rows, stored meshblocks, bisected bins and keyed draws."""

import glob
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from incrementa.functions import binning, morton
from incrementa.operators import displacements as ds
from incrementa.operators import volume as vol


def cube(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    data = {f: rng.normal(size=(n, n, n)) for f in vol.PRIMITIVES}
    rows = [(k, j, i, *(float(data[f][k, j, i]) for f in vol.PRIMITIVES)) for k in range(n) for j in range(n) for i in range(n)]
    return data, spark.createDataFrame(rows, "k int, j int, i int, " + ", ".join(f"{f} double" for f in vol.PRIMITIVES))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange", plan)), len(re.findall("Join", plan))


@pytest.mark.parametrize("n, tile", [(1, 4), (2, 64), (5, 4), (8, 4), (9, 4), (7, 1), (12, 5)])
def test_neighbours_across_tiles(spark, monkeypatch, n, tile):
    monkeypatch.setattr(vol, "TILE", tile)
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    df = spark.createDataFrame([(j, i, float(a[j, i])) for j in range(n) for i in range(n)], "j int, i int, f double")
    out = vol.with_in_plane_neighbours(df, ["f"], n)
    assert exchanges(out) == (1, 0)
    got = out.toPandas().sort_values(["j", "i"])
    assert list(got.columns) == ["j", "i", "f", "f_jp", "f_jm", "f_ip", "f_im"] and len(got) == n * n
    for name, want in (("f", a), ("f_jp", np.roll(a, -1, 0)), ("f_jm", np.roll(a, 1, 0)), ("f_ip", np.roll(a, -1, 1)), ("f_im", np.roll(a, 1, 1))):
        assert (got[name].to_numpy().reshape(n, n) == want).all()


def test_cells_without_a_neighbour_go(spark):
    df = spark.createDataFrame([(j, i, 1.0) for j in range(4) for i in range(4) if (j, i) != (1, 2)], "j int, i int, f double")
    left = {(r.j, r.i) for r in vol.with_in_plane_neighbours(df, ["f"], 4).collect()}
    assert left == {(j, i) for j in range(4) for i in range(4)} - {(1, 2), (0, 2), (2, 2), (1, 1), (1, 3)}


@pytest.mark.parametrize("tile", [3, 64])
def test_slice_in_one_exchange(spark, monkeypatch, tile):
    monkeypatch.setattr(vol, "TILE", tile)
    n = 7
    data, volume = cube(spark, n)
    d = lambda a, c: (np.roll(a, -1, 2 - c) - np.roll(a, 1, 2 - c)) * n / 2
    b = [data[f"bcc{c}"] for c in (1, 2, 3)]
    for axis, pick in ((1, lambda a: a[:, :, 0]), (2, lambda a: a[:, n - 1, :]), (3, lambda a: a[3])):
        value = -0.5 + ({1: 0, 2: n - 1, 3: 3}[axis] + 0.5) / n
        out = vol.extract_slice(volume, axis, value, n)
        assert exchanges(out) == (1, 0)
        got = out.toPandas().sort_values(["j", "i"])
        for name, want in (("dens", data["dens"]), ("currx", d(b[2], 1) - d(b[1], 2)), ("curry", d(b[0], 2) - d(b[2], 0)), ("grad_rho_x", d(data["dens"], 0)), ("grad_rho_z", d(data["dens"], 2))):
            np.testing.assert_allclose(got[name].to_numpy().reshape(n, n), pick(want), atol=1e-9)


def test_only_blocks_about_the_plane_are_read(spark, tmp_path):
    """All other blocks' files are overwritten with junk; 64 blocks, planes at a block's inside, face and the box's edge."""
    n, size = 8, 2
    _, volume = cube(spark, n)
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    gid = morton.encode(at("i"), at("j"), at("k"))
    path = str(tmp_path / "v")
    vol.store_volume(volume.select(gid.alias("gid"), "*"), path, size, n)
    stored = spark.read.parquet(f"{path}/layout")
    assert stored.count() == 64
    for axis, value, columns in ((3, -0.5 + 0.5 / n, 2), (1, -0.5 + 3.5 / n, 2), (2, 0.5, 2)):
        index = morton.slice_index(value, n)
        wanted = {r.gid for r in vol.blocks_about(stored, axis, index, size, n).collect()}
        assert len(wanted) == 16 * columns
        want = {tuple(r) for r in vol.extract_slice(volume, axis, value, n).collect()}
        copy = str(tmp_path / f"c{axis}")
        import shutil

        shutil.copytree(path, copy)
        for f in glob.glob(f"{copy}/cells/gid=*/*.parquet"):
            if int(re.search(r"gid=(\d+)", f)[1]) not in wanted:
                with open(f, "wb") as junk:
                    junk.write(b"junk")
        out = vol.extract_stored(spark.read.parquet(f"{copy}/layout").sparkSession, copy, axis, value, size, n)
        assert "dynamicpruning" in out._jdf.queryExecution().toString()
        assert {tuple(r) for r in out.collect()} == want


def test_cells_of_positions(spark):
    n = 24
    values = [-0.5 + k / n for k in range(n + 1)] + [math.nextafter(-0.5 + k / n, s) for k in range(n + 1) for s in (-1, 1)] + [-0.7, 0.7]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(morton.cell_of(F.col("v"), n)).collect()]
    for v, k in zip(values, got):
        try:
            assert morton.slice_index(v, n) == k
        except ValueError:
            assert k is None


@pytest.mark.parametrize("count", [2, 3, 40, 41, 501])
def test_bisected_bins(spark, count):
    rng = np.random.default_rng(count)
    edges = sorted(rng.normal(size=count).tolist())
    values = sorted({v for e in edges for v in (e, math.nextafter(e, -9), math.nextafter(e, 9))}) + rng.normal(size=200).tolist() + [float("nan"), float("inf"), -float("inf"), 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(binning.bin_index(F.col("v"), edges)).collect()]
    assert got == [int(np.searchsorted(edges, v, side="right")) - 1 if edges[0] <= v < edges[-1] else -1 for v in values]


def test_draws_do_not_depend_on_partitions(spark):
    rows = lambda n: sorted(tuple(r) for r in ds.candidates(spark, [1.0, 4.0, 20.0, 90.0], 3000, 9).repartition(n).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        one = rows(2)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == rows(7)
    drawn = spark.range(200000).select(ds.draw(9, F.lit(4), F.col("id")).alias("a"), ds.draw(9, F.lit(5), F.col("id")).alias("b"), ds.draw(10, F.lit(4), F.col("id")).alias("c"))
    frame = drawn.toPandas()
    for c in "abc":
        n = np.histogram(frame[c], 50, (0, 1))[0]
        assert ((n - 4000) ** 2 / 4000).sum() < 90  # chi-squared of 49 degrees, p about 3e-4
    assert abs(np.corrcoef(frame.to_numpy().T) - np.eye(3)).max() < 0.01 and abs(np.corrcoef(frame["a"][1:], frame["a"][:-1])[0, 1]) < 0.01
