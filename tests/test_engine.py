"""Driver-side pieces, edge cases and a brute-force histogram."""

import math
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from incrementa.functions import binning, morton, physics
from incrementa.operators import channels as ch
from incrementa.operators import displacements as ds
from incrementa.operators import sampling as sm
from incrementa.operators import volume as vol
from incrementa.plans import fixtures as fx
from incrementa.plans import jobs
from incrementa.plans.analysis import analyse_slice, analyse_slices, framed_samples, simple_increments, with_derived
from incrementa.plans.queries import QUERIES
from incrementa.sources import config as cf
from incrementa.sources import slices as sl
from incrementa.streaming.accumulate import running_counts, watch_histograms

NAN = float("nan")


# ---- scale bins and displacements


def test_scale_edges_known():
    assert ds.scale_edges(1, 38, 8) == [1, 2, 3, 5, 8, 11, 17, 25, 38]
    edges = ds.scale_edges(1, 122, 16)
    assert len(edges) == 17 and edges[:12] == [1, 2, 3, 4, 5, 6, 8, 11, 14, 19, 25, 32]
    for hi, n, want in ((160, 128, 129), (80, 32, 33), (387, 32, 33)):
        assert len(ds.scale_edges(1, hi, n)) == want
    with pytest.warns(UserWarning):
        assert len(ds.scale_edges(1, 122, 128)) == 114


@pytest.mark.parametrize("lo,hi,n", [(1, 100, 10), (1, 10, 5), (1, 1000, 50), (1, 100, 1), (10, 11, 1)])
def test_scale_edges_shape(lo, hi, n):
    e = ds.scale_edges(lo, hi, n)
    assert len(e) == n + 1 and e[0] == lo and e[-1] == hi and all(b > a and b == int(b) for a, b in zip(e, e[1:]))


@pytest.mark.parametrize("args", [(-1, 10, 5), (0, 10, 5), (100, 50, 5), (100, 100, 5), (1, 10, 0), (1, 10, -5)])
def test_scale_edges_errors(args):
    with pytest.raises(ValueError):
        ds.scale_edges(*args)


def test_displacement_list(spark):
    got = [tuple(r) for r in ds.displacement_list(spark, [1.0, 10.0, 100.0], 400, 42).orderBy("disp_id").collect()]
    assert got == [tuple(r) for r in ds.displacement_list(spark, [1.0, 10.0, 100.0], 400, 42).orderBy("disp_id").collect()]
    vectors = {(x, y) for _, x, y in got}
    assert len(vectors) == len(got) and (0, 0) not in vectors and not any((-x, -y) in vectors for x, y in vectors)
    lengths = [x * x + y * y for _, x, y in got]
    assert lengths == sorted(lengths) and lengths[-1] <= 101**2
    with pytest.raises(ValueError):
        ds.candidates(spark, [5.0, 5.0], 10)
    with pytest.raises(ValueError):
        ds.quota(0, 3)
    with pytest.warns(UserWarning):
        ds.quota(10, 5)


def test_largest_scale():
    assert [ds.largest_scale(122, w) for w in (2, 3, 5)] == [61, 30, 15]


# ---- bins


def test_bins_at_edges(spark):
    edges = binning.value_edges()
    tests = sorted({v for e in edges for v in (e, math.nextafter(e, 0), math.nextafter(e, 99))}) + [NAN, float("inf"), 0.0, -1.0]
    df = spark.createDataFrame([(v,) for v in tests], "v double")
    for f, ed in ((binning.log_bin, edges), (binning.bin_index, edges), (binning.even_bin, binning.theta_edges()), (binning.log_bin, binning.product_edges())):
        got = [r[0] for r in df.select(f(F.col("v"), ed)).collect()]
        want = [-1 if not ed[0] <= v < ed[-1] else int(np.searchsorted(ed, v, side="right")) - 1 for v in tests]
        assert got == want


# ---- morton and volume


def test_morton_round_trip():
    for code in (0, 1, 777, (1 << 18) - 1):
        c, b, a = morton.decode_int(code)
        assert morton.encode_int(a, b, c) == code
    with pytest.raises(ValueError):
        morton.encode_int(64, 0, 0)
    with pytest.raises(ValueError):
        morton.decode_int(1 << 18)


def test_slice_index():
    assert morton.slice_index(0.0, 10) == 4 and morton.slice_index(0.5, 10) == 9 and morton.slice_index(-0.49, 10) == 0
    for bad in (-0.5, 0.51):
        with pytest.raises(ValueError):
            morton.slice_index(bad, 10)
    with pytest.raises(ValueError):
        vol.check_axis(4)


def test_extract_slice_against_numpy(spark):
    n, rng = 6, np.random.default_rng(1)
    data = {f: rng.normal(size=(n, n, n)) for f in vol.PRIMITIVES}
    rows = [(k, j, i, *(float(data[f][k, j, i]) for f in vol.PRIMITIVES)) for k in range(n) for j in range(n) for i in range(n)]
    volume = spark.createDataFrame(rows, "k int, j int, i int, " + ", ".join(f"{f} double" for f in vol.PRIMITIVES))
    d = lambda a, c: (np.roll(a, -1, 2 - c) - np.roll(a, 1, 2 - c)) * n / 2
    v = [data[f"vel{c}"] for c in "xyz"]
    b = [data[f"bcc{c}"] for c in (1, 2, 3)]
    unit = [x / np.sqrt(sum(y * y for y in b) + 1e-10) for x in b]
    want = {"vortx": d(v[2], 1) - d(v[1], 2), "vorty": d(v[0], 2) - d(v[2], 0), "vortz": d(v[1], 0) - d(v[0], 1), "currz": d(b[1], 0) - d(b[0], 1), "curvy": sum(unit[k] * d(unit[1], k) for k in range(3)), "grad_rho_z": d(data["dens"], 2)}
    for axis, pick in ((1, lambda a: a[:, :, 2]), (2, lambda a: a[:, 2, :]), (3, lambda a: a[2])):
        got = vol.extract_slice(volume, axis, -0.5 + 2.5 / n, n).toPandas().sort_values(["j", "i"])
        for name, a in want.items():
            np.testing.assert_allclose(got[name].to_numpy().reshape(n, n), pick(a), atol=1e-9)


# ---- physics


def test_alfven(spark):
    rows = [(1.0, 0.0, 0.0, 4.0), (3.0, 6.0, 9.0, 9.0), (1.0, 1.0, 1.0, -1.0), (1.0, 1.0, 1.0, 0.0), (1.0, 1.0, 1.0, NAN)]
    got = physics.alfven(spark.createDataFrame(rows, "b_x double, b_y double, b_z double, rho double")).select("va_x", "va_y", "va_z").collect()
    assert [tuple(r) for r in got] == [(0.5, 0, 0), (1, 2, 3), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_elsasser_and_reports(spark):
    names = [f"{v}_{c}" for v in ("v", "va") for c in "xyz"]
    df = spark.createDataFrame([(3.0, 4.0, 5.0, 1.0, 2.0, 3.0), (NAN, 0.0, 0.0, 1.0, float("inf"), 1.0)], ", ".join(f"{n} double" for n in names))
    first = physics.elsasser(df).first()
    assert [first[f"zp_{c}"] for c in "xyz"] == [4, 6, 8] and [first[f"zm_{c}"] for c in "xyz"] == [2, 2, 2]
    assert [tuple(r) for r in physics.finite_report(df, ["v_x", "va_y"]).collect()] == [("v_x", 1, 0), ("va_y", 0, 1)]


# ---- histograms against brute force


def brute_histograms(fields, disp, edges, axis, width):
    n = fields["rho"].shape[0]
    weights = sm.STENCILS[width]
    mags, prods = {}, {}
    bin_of = lambda v, e: -1 if not e[0] <= v < e[-1] else int(np.searchsorted(e, v, side="right")) - 1
    for di, dj in disp:
        r = math.sqrt(di * di + dj * dj)
        ell = bin_of(r, edges)
        if ell < 0:
            continue
        d = {1: (0, di, dj), 2: (di, 0, dj), 3: (di, dj, 0)}[axis]
        d = np.array(d, float)
        for j in range(n):
            for i in range(n):
                at = {k: ((j + k * dj) % n, (i + k * di) % n) for k in weights}
                inc = {v: sum(w * np.array([fields[f"{v}_{c}"][at[k]] for c in "xyz"]) for k, w in weights.items()) for v in ch.VECTORS}
                drho = sum(w * fields["rho"][at[k]] for k, w in weights.items())
                m = sum(np.array([fields[f"b_{c}"][p] for c in "xyz"]) for p in at.values()) / width
                size = np.linalg.norm(m)
                if size < 1e-10 or not np.isfinite(size):
                    continue
                theta = math.acos(min(abs(d @ m) / (r * size), 1))
                u = m / size
                perp = {v: x - u * (x @ u) for v, x in inc.items()}
                e = d - m * (d @ m) / size**2
                p, q = np.linalg.norm(e), np.linalg.norm(perp["b"])
                phi = math.acos(max(-1, min(1, e @ perp["b"] / (p * q)))) if p > 0 and q > 0 else 0.0
                t, f = bin_of(theta, binning.theta_edges()), bin_of(phi, binning.phi_edges())
                if t < 0 or f < 0:
                    continue
                for name, v in ch.MAGNITUDES.items():
                    x = abs(drho) if v == "rho" else np.linalg.norm(inc[v])
                    if (b := bin_of(x, binning.value_edges())) >= 0:
                        mags[name, ell, t, f, b] = mags.get((name, ell, t, f, b), 0) + 1
                for name, (kind, a, c) in ch.PRODUCTS.items():
                    left, right = (perp[a], perp[c]) if kind.startswith("perp") else (inc[a], inc[c])
                    x = np.linalg.norm(np.cross(left, right)) if kind.endswith("cross") else np.linalg.norm(left) * np.linalg.norm(right)
                    if (b := bin_of(x, binning.product_edges())) >= 0:
                        prods[name, ell, b] = prods.get((name, ell, b), 0) + 1
    return mags, prods


@pytest.mark.parametrize("axis,width", [(3, 2), (1, 3), (2, 5)])
def test_histograms_against_brute(spark, axis, width):
    n, rng = 8, np.random.default_rng(axis)
    names = ["rho", *(f"{v}_{c}" for v in ("v", "b", "omega", "j", "curv", "grad_rho") for c in "xyz")]
    data = {f: rng.normal(size=(n, n)) for f in names}
    data["rho"] = np.abs(data["rho"]) + 0.2
    data["omega_x"][2, 3] = NAN
    data["b_x"][5, 5] = NAN
    rows = [(j, i, *(float(data[f][j, i]) for f in names)) for j in range(n) for i in range(n)]
    grid = with_derived(spark.createDataFrame(rows, "j int, i int, " + ", ".join(f"{f} double" for f in names)))
    for v, s in (("va", 0), ("zp", 1), ("zm", -1)):
        for c in "xyz":
            va = data[f"b_{c}"] / np.sqrt(data["rho"])
            data[f"{v}_{c}"] = va if s == 0 else data[f"v_{c}"] + s * va
    disp, edges = [(1, 0), (0, 1), (2, 1), (3, 3), (9, 9)], [1.0, 2.0, 4.0, 8.0]
    d = spark.createDataFrame([(k, *x) for k, x in enumerate(disp)], "disp_id int, di int, dj int")
    samples = sm.every_position(sm.with_scale(d, edges), grid)
    rows = framed_samples(grid, samples, n, n, axis, width)
    mags, prods = brute_histograms(data, disp, edges, axis, width)
    assert {tuple(r)[:-1]: r["count"] for r in ch.magnitude_histogram(rows).collect()} == mags
    assert {tuple(r)[:-1]: r["count"] for r in ch.product_histogram(rows).collect()} == prods


def test_perpendicular_field_drops_all(spark):
    grid = with_derived(spark.createDataFrame([(j, i, 1.0, float(i), 0.0, 0.0, 0.0, 0.0, 1.0) for j in range(4) for i in range(4)], "j int, i int, rho double, v_x double, v_y double, v_z double, b_x double, b_y double, b_z double"))
    d = sm.with_scale(spark.createDataFrame([(0, 1, 0)], "disp_id int, di int, dj int"), [1.0, 2.0])
    assert framed_samples(grid, sm.every_position(d, grid), 4, 4, 3, 2, ["D_V"]).count() == 0


def test_weak_field_drops_all(spark):
    grid = with_derived(spark.createDataFrame([(j, i, 1.0, float(i), 0.0, 0.0, 0.0, 0.0, 0.0) for j in range(4) for i in range(4)], "j int, i int, rho double, v_x double, v_y double, v_z double, b_x double, b_y double, b_z double"))
    d = sm.with_scale(spark.createDataFrame([(0, 1, 0)], "disp_id int, di int, dj int"), [1.0, 2.0])
    assert framed_samples(grid, sm.every_position(d, grid), 4, 4, 3, 2, ["D_V"]).count() == 0


def test_affine_samples_are_distinct(spark):
    d = spark.createDataFrame([(k, 1, 0) for k in range(3)], "disp_id int, di int, dj int")
    got = sm.affine_samples(d, 9, 7, 63)
    assert got.select("disp_id", "j", "i").distinct().count() == 189
    with pytest.raises(ValueError):
        sm.affine_samples(d, 3, 3, 10)
    with pytest.raises(ValueError):
        sm.stencil(4)


def plane_rows(n):
    return [(j, i, 1.0 + 0.1 * math.sin(i), math.sin(i + j), math.cos(j), 0.3 * i, 1.0, math.sin(j), math.cos(i * j)) for j in range(n) for i in range(n)]


PLANE = "j int, i int, rho double, v_x double, v_y double, v_z double, b_x double, b_y double, b_z double"


def test_whole_analyses(spark, tmp_path):
    df = spark.createDataFrame(plane_rows(24), PLANE)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        one = analyse_slice(df, n_displacements=40, n_ell_bins=4, n_random_subsamples=50, axis=3, seed=1)
        two = analyse_slices(df.crossJoin(spark.createDataFrame([("a",), ("b",)], "slice_id string")), 24, 24, n_displacements=40, n_ell_bins=4, n_random_subsamples=50, seed=1)
        assert simple_increments(df, n_displacements=40, n_ell_bins=3, n_samples=10).where("dv is null").count() == 0
    total = lambda h: h.agg(F.sum("count")).first()[0]
    assert total(two.magnitudes) == 2 * total(one.magnitudes) > 0 and total(two.products) == 2 * total(one.products)
    assert total(one.counts) == total(one.magnitudes) + total(one.products)
    assert {r.channel for r in one.magnitudes.select("channel").distinct().collect()} == {"D_V", "D_B", "D_RHO", "D_VA", "D_ZPLUS", "D_ZMINUS"}
    cf.write_result({"hist_mag": one.magnitudes, "edges": one.edges}, {"axis": 3}, str(tmp_path / "r"))
    assert total(cf.read_result(spark, str(tmp_path / "r"), "hist_mag")) == total(one.magnitudes)
    assert cf.read_result(spark, str(tmp_path / "r"), "run_meta").first()[0] == {"axis": "3"}
    with pytest.raises(ValueError):
        analyse_slice(df.drop("rho"))


def test_stream_of_histograms(spark, tmp_path):
    schema = "channel string, ell_bin int, count long"
    path = str(tmp_path / "h")
    for _ in range(2):
        spark.createDataFrame([("D_V", 1, 5), ("D_V", 2, 1)], schema).coalesce(1).write.mode("append").parquet(path)
    q = watch_histograms(spark, path, schema).writeStream.format("memory").queryName("hist_totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in running_counts(spark.read.parquet(path)).collect()}
    assert {tuple(r) for r in spark.table("hist_totals").collect()} == want == {("D_V", 1, 10), ("D_V", 2, 2)}


# ---- sources


@pytest.mark.parametrize("name,want", [("slice_x1_-0.375_beta25_test.npz", (1, 25.0)), ("slice_x2_0.0_beta10.5_data.npz", (2, 10.5)), ("slice_x3_1.5_beta0.1_final.npz", (3, 0.1)), ("path/to/slice_x1_pos_beta100_file.npz", (1, 100.0))])
def test_names(name, want):
    assert sl.parse_name(name) == want


@pytest.mark.parametrize("name", ["slice_x4_0_beta1.npz", "slice_y1_0_beta1.npz", "slice_x1_0.npz", "slice_x1_0_betax.npz"])
def test_bad_names(name):
    with pytest.raises(ValueError):
        sl.parse_name(name)


def test_npz(spark, tmp_path):
    a = np.arange(100.0).reshape(10, 10)
    np.savez(tmp_path / "s.npz", dens=a, velx=2 * a, other=np.zeros(3))
    df = sl.read_npz(spark, str(tmp_path))
    rows = sl.strided(df.drop("slice_id"), 3)
    assert sl.check_dense(df) == (10, 10) and rows.count() == 16
    assert {(r.j, r.i): r.rho for r in sl.canonical(rows).collect()} == {(j // 3, i // 3): a[j, i] for j in range(0, 10, 3) for i in range(0, 10, 3)}
    assert math.isnan(df.first()["bcc1"])
    np.savez(tmp_path / "t.npz", dens=a, velx=np.zeros((2, 2)))
    with pytest.raises(Exception, match="different shapes"):
        sl.read_npz(spark, str(tmp_path)).count()


def test_source_errors(spark, tmp_path):
    for bad, error in ((0, ValueError), (-1, ValueError), (1.5, TypeError), (True, TypeError)):
        with pytest.raises(error):
            sl.check_stride(bad)
    with pytest.raises(FileNotFoundError):
        sl.check_npz_path(tmp_path / "none.npz")
    (tmp_path / "x.txt").write_text("")
    for p, error in ((tmp_path / "x.txt", ValueError), (tmp_path, ValueError), (3, TypeError)):
        with pytest.raises(error):
            sl.check_npz_path(p)
    with pytest.raises(ValueError):
        sl.check_dense(spark.createDataFrame([(0, 0), (1, 1)], "j int, i int"))
    with pytest.raises(ValueError):
        sl.load_slice(spark.createDataFrame([(0,)], "q int"))
    assert sl.slice_name("run", 3, -0.25, 7) == "run_axis3_slicem0p25_file0007"


# ---- configuration


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.yaml"
    p.write_text("analysis: {stride: 2, n_ell_bins: 8}\nprofiles:\n  fast: {analysis: {stride: 4}}\n")
    assert cf.load_config(p)["analysis"] == {"stride": 2, "n_ell_bins": 8}
    assert cf.load_config(p, "fast")["analysis"] == {"stride": 4, "n_ell_bins": 8}
    for args, error in (((tmp_path / "no.yaml",), FileNotFoundError), ((p, "none"), KeyError)):
        with pytest.raises(error):
            cf.load_config(*args)
    (tmp_path / "e.yaml").write_text("")
    assert cf.load_config(tmp_path / "e.yaml") == {}
    got = cf.parse_arguments(["--config", str(p), "--n_ell_bins", "5", "--file_name", "x"])
    assert (got.stride, got.n_ell_bins, got.n_disp_total) == (2, 5, 1000)
    for bad in ({"stride": 0}, {"stencil_width": 4}, {"n_processes": -1}, {"file_name": None}, {"slice_list": "l"}):
        with pytest.raises(ValueError):
            cf.validate(cf.RunConfig(**{"file_name": "x"} | bad))
    assert cf.deep_merge({"a": 1, "b": {"x": 1, "y": 2}}, {"b": {"y": 3, "z": 4}, "d": 5}) == {"a": 1, "b": {"x": 1, "y": 3, "z": 4}, "d": 5}
    t = cf.write_template(tmp_path / "t.yaml")
    assert cf.load_config(t, "test")["analysis"]["stride"] == 4
    with pytest.raises(FileExistsError):
        cf.write_template(t)
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv(cf.ENVIRONMENT, str(p))
    assert cf.default_path() == p


def test_header():
    header = cf.read_header("<mesh>\nnx1 = 320 # cells\n<meshblock>\nnx1=160\nnx2 = 160\nnx3 = 160\n")
    assert cf.mesh_of(header) == (320, (160, 160, 160))
    with pytest.raises(KeyError):
        cf.mesh_of({})


# ---- positions drawn by seed


def test_permuted_samples(spark):
    d = spark.createDataFrame([(k, 1, 0) for k in range(3)], "disp_id int, di int, dj int")
    drawn = lambda seed, rows=9, columns=7, n=63: {(r.disp_id, r.k): (r.j, r.i) for r in sm.permuted_samples(d, rows, columns, n, seed).collect()}
    one, two = drawn(1), drawn(2)
    assert all(len({v for (k, _), v in one.items() if k == x}) == 63 for x in range(3))
    assert one != two and one == drawn(1)
    with pytest.raises(ValueError):
        sm.permuted_samples(d, 3, 3, 10)
    # spread over a large slice: rows and columns of 16 x 16 boxes, apart for each displacement
    far = drawn(0, 4096, 4096, 5000)
    for x in range(3):
        for axis in (0, 1):
            n = np.bincount([v[axis] // 256 for (k, _), v in far.items() if k == x], minlength=16)
            assert ((n - 312.5) ** 2 / 312.5).sum() < 45  # chi-squared of 15 degrees, p about 1e-4
    assert len(set(far.values())) > 14980


def test_tasks_grow_with_samples(spark, sf, monkeypatch):
    """A task's share of the samples, and of the places that are counted, stays as the slice grows."""
    d = spark.createDataFrame([(k, 1, 0) for k in range(3)], "disp_id int, di int, dj int")
    assert sm.permuted_samples(d, 9, 7, 63).rdd.getNumPartitions() == 8
    assert sm.permuted_samples(d, 1024, 1024, 1024 * 1024).rdd.getNumPartitions() == 16
    monkeypatch.setattr(sm, "TASK_SAMPLES", 500)
    df = QUERIES["smp_1_random"](spark, sf)
    assert re.findall(r"hashpartitioning\(disp_id#\d+, j#\d+, i#\d+, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()) == ["30"]
    assert sorted(map(tuple, df.collect())) == [(k, 14884, 14884, True) for k in range(8)]


# ---- jobs


@pytest.fixture(scope="module")
def slice_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("slices")
    rng = np.random.default_rng(3)
    for name in ("slice_x3_0_beta25.npz", "slice_x3_1_beta25.npz"):
        np.savez(folder / name, **{k: rng.normal(size=(16, 16)) + (k == "dens") * 9 for k in ("dens", "velx", "vely", "velz", "bcc1", "bcc2", "bcc3")})
    np.savez(folder / "broken_x3.npz", dens=np.ones((4, 4)))
    return folder


def test_batch_run(spark, slice_folder, tmp_path):
    found = jobs.list_slices(spark, f"file://{slice_folder}", str(tmp_path / "list"), "slice_*.npz")
    assert [p.rsplit("/", 1)[1] for p in found] == ["slice_x3_0_beta25.npz", "slice_x3_1_beta25.npz"]
    run = cf.RunConfig(slice_list=str(tmp_path / "list"), n_disp_total=40, n_random_subsamples=30, n_ell_bins=4)
    settings = cf.settings_of({"binning": {"n_theta_bins": 3, "n_value_edges": 9}, "output": {"directory": str(tmp_path / "results")}})
    out = jobs.run_batch(spark, run, settings, seed=1)
    assert out.startswith(str(tmp_path / "results"))
    counts = cf.read_result(spark, out, "counts").cache()
    assert counts.agg(F.max("theta_bin")).first()[0] == 2 and counts.agg(F.max("value_bin")).first()[0] <= 7
    meta = cf.read_result(spark, out, "run_meta").first()["meta"]
    assert meta == {"n_slices": "2", "stride": "1", "stencil_width": "2", "N_random_subsamples": "30", "axis": "3", "beta": "25.0"}
    assert cf.read_result(spark, out, "channels").count() == 28 and cf.read_result(spark, out, "edges").where("kind = 'theta'").count() == 4
    drawn = 2 * 30 * cf.read_result(spark, out, "displacements").count()
    total = counts.where("channel = 'D_V'").agg(F.sum("count")).first()[0]
    assert 0 < total <= drawn and cf.read_result(spark, out, "curves").where("channel = 'D_V'").agg(F.sum("count")).first()[0] == total
    assert jobs.products_of(counts).columns == ["ell_bin", "product_bin", "count", "channel"] or "product_bin" in jobs.products_of(counts).columns
    other = jobs.run_batch(spark, run, settings, str(tmp_path / "other"), seed=2)
    again = jobs.run_batch(spark, run, settings, str(tmp_path / "again"), seed=1)
    rows = lambda p: sorted(map(repr, cf.read_result(spark, p, "counts").collect()))
    assert rows(again) == rows(out) != rows(other)
    with pytest.raises(ValueError, match="stride"):
        jobs.run_batch(spark, cf.RunConfig(file_name=found[0], stride=17), settings)
    with pytest.raises(FileNotFoundError):
        jobs.run_batch(spark, cf.RunConfig(file_name=f"{slice_folder}/slice_x3_9_beta1.npz"), settings)
    with pytest.raises(FileNotFoundError):
        jobs.list_slices(spark, f"file://{slice_folder}", str(tmp_path / "none"), "nothing*.npz")


def test_simple_run_isolates_slices(spark, slice_folder, tmp_path):
    paths = [f"{slice_folder}/{n}" for n in ("broken_x3.npz", "slice_x3_0_beta25.npz", "slice_x3_8_beta1.npz")]
    cf.write_slice_list(spark, paths, str(tmp_path / "list"))
    run = cf.RunConfig(slice_list=str(tmp_path / "list"), n_disp_total=30, n_random_subsamples=20, n_ell_bins=3)
    failed = jobs.run_simple(spark, run, str(tmp_path / "out"))
    assert sorted(failed) == [paths[0], paths[2]] and failed[paths[2]].startswith("FileNotFoundError")
    raw = jobs.read_simple(spark, str(tmp_path / "out"))
    assert raw.columns == ["disp_id", "r", "dv", "db", "drho"] and raw.agg(F.max("disp_id")).first()[0] <= 19
    assert jobs.simple_curves(spark, str(tmp_path / "out"), "slice_x3_0_beta25").count() > 0
    with pytest.raises(FileNotFoundError):
        jobs.read_simple(spark, str(tmp_path / "empty"))


def test_settings_are_honoured_or_refused(tmp_path, capsys):
    assert cf.parse_arguments(["--N_random_subsamples", "7", "--file_name", "x"], False).n_random_subsamples == 7
    p = tmp_path / "c.yaml"
    p.write_text("analysis: {N_random_subsamples: 9}\nphysics: {min_density: 0.5}\n")
    run, settings = cf.parse_run(["--config", str(p), "--file_name", "x"])
    assert run.n_random_subsamples == 9 and settings.min_density == 0.5
    for text in ("analysis: {n_samples: 3}", "binning: {theta: 3}", "physics: {min_density: 0}", "binning: {sf_range: [2.0, 1.0]}"):
        p.write_text(text)
        with pytest.raises(ValueError):
            cf.parse_run(["--config", str(p), "--file_name", "x"])
    with pytest.raises(SystemExit):
        cf.parse_run(["--print-config"], False)
    assert '"n_ell_bins": 128' in capsys.readouterr().out
    template = cf.load_config(cf.write_template(tmp_path / "t.yaml"), "production")
    assert cf.settings_of(template) == cf.Settings() and template["analysis"]["n_disp_total"] == 5000


def test_fields_are_checked(spark):
    with pytest.raises(ValueError, match="lacks"):
        analyse_slice(spark.createDataFrame([(0, 0, 1.0)], "j int, i int, rho double"))
    text = spark.createDataFrame([(0, 0, "a", *[1.0] * 6)], "j int, i int, rho string, v_x double, v_y double, v_z double, b_x double, b_y double, b_z double")
    with pytest.raises(TypeError, match="rho"):
        analyse_slice(text)
    for rows in ([(0, 0), (0, 0), (1, 1), (1, 1)], [(0, 0), (0, 1), (1, 0), (1, 0)], [(1, 1), (1, 2), (2, 1), (2, 2)]):
        with pytest.raises(ValueError):
            sl.check_dense(spark.createDataFrame(rows, "j int, i int"))
