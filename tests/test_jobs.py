"""Many slices in one job, stored slices keyed by content, histograms added up exactly once, quality observed."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from incrementa.operators import statistics as st
from incrementa.plans import fixtures as fx
from incrementa.plans import jobs
from incrementa.sources import config as cf
from incrementa.streaming.accumulate import accumulate, add_batch, applied, latest, totals

SEVEN = ("dens", "velx", "vely", "velz", "bcc1", "bcc2", "bcc3")


def job_count(spark, f):
    """How many Spark jobs ``f`` runs."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{id(f)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        f()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def five_hundred(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("many"), np.random.default_rng(2)
    for k in range(500):
        np.savez(folder / f"slice_x3_{k}_beta25.npz", **{f: rng.normal(size=(8, 8)) + 9 * (f == "dens") for f in SEVEN})
    (folder / "slice_x3_77_beta25.npz").write_bytes(b"broken" * 40)
    np.savez(folder / "slice_x3_78_beta25.npz", **{f: np.ones((12, 12)) for f in SEVEN})
    np.savez(folder / "slice_x3_79_beta25.npz", **{f: np.ones((6, 6)) for f in SEVEN})
    return folder


def test_five_hundred_slices_in_one_job(spark, five_hundred, tmp_path):
    paths = jobs.discovered(spark, f"file://{five_hundred}")
    cf.write_slice_list(spark, paths, str(tmp_path / "list"))
    run = cf.RunConfig(slice_list=str(tmp_path / "list"), n_disp_total=20, n_random_subsamples=10, n_ell_bins=2)
    failed = {}
    jobs_run = job_count(spark, lambda: failed.update(jobs.run_simple(spark, run, str(tmp_path / "out"))))
    assert sorted(failed) == [p for p in paths if "_77_" in p or "_79_" in p]
    assert [text.split(":")[0] for _, text in sorted(failed.items())] == ["BadZipFile", "ValueError"]
    assert jobs_run < 40  # not a job a slice
    whole = spark.read.parquet(str(tmp_path / "out/simple_sf/increments"))
    each = whole.groupBy("slice").agg(F.count("*").alias("n"))
    assert each.count() == 498 and each.where("slice <> 'slice_x3_78_beta25.npz'").select("n").distinct().count() == 1
    one = jobs.read_simple(spark, str(tmp_path / "out"), "slice_x3_5_beta25")
    assert one.count() == whole.where("slice = 'slice_x3_5_beta25.npz'").count() > 0
    with pytest.raises(ValueError, match="_77_"):
        jobs.run_batch(spark, run, out=str(tmp_path / "bad"))


def test_one_job_equals_slice_by_slice(spark, five_hundred, tmp_path):
    names = [f"{five_hundred}/slice_x3_{k}_beta25.npz" for k in (1, 2, 3)]
    cf.write_slice_list(spark, names, str(tmp_path / "list"))
    options = {"n_disp_total": 20, "n_random_subsamples": 10, "n_ell_bins": 2}
    jobs.run_simple(spark, cf.RunConfig(slice_list=str(tmp_path / "list"), **options), str(tmp_path / "all"))
    rows = lambda df: sorted(map(repr, df.collect()))
    for path in names:
        jobs.run_simple(spark, cf.RunConfig(file_name=path, **options), str(tmp_path / path[-20:]))
        name = path.rsplit("/", 1)[1]
        assert rows(jobs.read_simple(spark, str(tmp_path / "all"), name)) == rows(jobs.read_simple(spark, str(tmp_path / path[-20:])))
    together = jobs.run_batch(spark, cf.RunConfig(slice_list=str(tmp_path / "list"), **options), out=str(tmp_path / "b"), seed=4)
    alone = [jobs.run_batch(spark, cf.RunConfig(file_name=p, **options), out=str(tmp_path / f"b{k}"), seed=4) for k, p in enumerate(names)]
    total = st.merged([cf.read_result(spark, a, "counts") for a in alone])
    assert rows(cf.read_result(spark, together, "counts").select(*total.columns)) == rows(total)


def test_folders_and_archives_in_one_run(spark, five_hundred, tmp_path):
    archive = f"{five_hundred}/slice_x3_4_beta25.npz"
    grid, sizes, _ = jobs.read_slices(spark, [archive])
    folder = str(tmp_path / "slice_x3_9_beta25")
    grid.drop("slice_id", "omega_x").withColumn("rho", F.col("rho") + 1).withColumnsRenamed({v: k for k, v in jobs_fields().items()}).write.parquet(folder)
    both, sizes, wrong = jobs.read_slices(spark, [archive, folder, str(tmp_path / "none")], capture=True)
    assert sizes == {archive: (8, 8), folder: (8, 8)} and list(wrong) == [str(tmp_path / "none")]
    assert {r.slice_id: r.n for r in both.groupBy("slice_id").agg(F.count("*").alias("n")).collect()} == {"slice_x3_4_beta25.npz": 64, "slice_x3_9_beta25": 64}
    with pytest.raises(ValueError, match="different names"):
        jobs.read_slices(spark, ["a/x.npz", "b/x.npz"])


def jobs_fields():
    from incrementa.sources.slices import FIELDS

    return FIELDS


def test_quality_is_observed(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = {f: rng.normal(size=(8, 8)) + 9 * (f == "dens") for f in SEVEN}
    data["dens"][0, 0], data["velx"][1, 1], data["bcc3"][2, 2], data["bcc2"][2, 3] = -1.0, np.nan, np.inf, -np.inf
    np.savez(tmp_path / "slice_x3_0_beta1.npz", **data)
    for names in (["slice_x3_0_beta1.npz"], ["slice_x3_0_beta1.npz", "slice_x3_1_beta1.npz"]):
        if len(names) > 1:
            np.savez(tmp_path / names[1], **data)
        cf.write_slice_list(spark, [str(tmp_path / n) for n in names], str(tmp_path / f"list{len(names)}"))
        out = jobs.run_batch(spark, cf.RunConfig(slice_list=str(tmp_path / f"list{len(names)}"), n_disp_total=20, n_random_subsamples=10, n_ell_bins=2), out=str(tmp_path / f"o{len(names)}"))
        got = {r.name: r.value for r in cf.read_result(spark, out, "quality").collect()}
        n = len(names)
        assert got == {"n_cells": 64 * n, "n_bad_density": n, "rho_min": -1.0, "n_nan": n, "n_inf": 2 * n}


def test_slices_are_kept_by_content(spark, sf, tmp_path):
    volume, n = fx.volume(spark, sf), fx.volume_size(spark, sf)
    folder = str(tmp_path)
    one = jobs.extracted(spark, volume, 1, 0.0, n, folder)
    path = next(tmp_path.glob("run_axis1_slice0_file0000/key=*/_SUCCESS"))
    made = path.stat().st_mtime_ns
    again = jobs.extracted(spark, volume.repartition(3), 1, 0.0, n, folder)
    assert path.stat().st_mtime_ns == made and one.count() == again.count() == n * n
    # a cell of the plane changes, then one far from it
    normal = jobs.slice_index(0.0, n)
    changed = lambda at: volume.withColumn("dens", F.when((F.col("i") == at) & (F.col("j") == 0) & (F.col("k") == 0), 99.0).otherwise(F.col("dens")))
    other = jobs.extracted(spark, changed(normal), 1, 0.0, n, folder)
    assert other.agg(F.max("dens")).first()[0] == 99.0 and one.agg(F.max("dens")).first()[0] < 99.0
    jobs.extracted(spark, changed((normal + n // 2) % n), 1, 0.0, n, folder)
    assert len(list(tmp_path.glob("run_axis1_slice0_file0000/key=*"))) == 2


def test_writers_at_the_same_time(spark, tmp_path):
    frame = spark.range(10)
    won, path = [], str(tmp_path / "target")

    def write(k):
        frame.write.parquet(str(tmp_path / f"aside{k}"))
        won.append(jobs.moved_once(spark, str(tmp_path / f"aside{k}"), path))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 5 + [True] and spark.read.parquet(path).count() == 10
    assert not list(tmp_path.glob("aside*"))


SCHEMA = "slice_id string, channel string, ell_bin int, count long"


def counts(df):
    return {(r.channel, r.ell_bin): r["count"] for r in df.collect()}


def test_slices_are_added_exactly_once(spark, tmp_path):
    folder, src = str(tmp_path / "totals"), tmp_path / "in"

    def deliver(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / name))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src) + "/*")
        accumulate(stream, folder, str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    deliver("a", [("s1", "D_V", 1, 5), ("s1", "D_V", 2, 1)])
    deliver("b", [("s2", "D_V", 1, 10), (None, "D_V", 1, 1000)])
    run()
    assert counts(totals(spark, folder)) == {("D_V", 1): 15, ("D_V", 2): 1} and latest(spark, folder) == 1
    # the last batch is replayed: as after a failure between the version and the query's own log
    import shutil

    commits = sorted(p for p in (tmp_path / "log/commits").iterdir() if not p.name.startswith("."))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert counts(totals(spark, folder)) == {("D_V", 1): 15, ("D_V", 2): 1} and latest(spark, folder) == 1
    # a slice is delivered again under another name, with one that is new
    deliver("c", [("s2", "D_V", 1, 10), ("s3", "D_B", 1, 7)])
    run()
    assert counts(totals(spark, folder)) == {("D_V", 1): 15, ("D_V", 2): 1, ("D_B", 1): 7}
    assert {r.slice_id for r in applied(spark, folder).collect()} == {"s1", "s2", "s3"}
    for k in range(4):
        add_batch(spark.createDataFrame([(f"t{k}", "D_V", 1, 1)], SCHEMA), 10 + k, folder)
    assert counts(totals(spark, folder))["D_V", 1] == 19 and len(list((tmp_path / "totals").glob("version=*"))) == 2
    with pytest.raises(FileNotFoundError):
        totals(spark, str(tmp_path / "none"))


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "t")
    add_batch(spark.createDataFrame([("a", "D_V", 1, 1)], SCHEMA), 0, folder)
    spark.createDataFrame([("x", "D_V", 1, 9)], SCHEMA).write.parquet(f"{folder}/_writing-dead/totals")
    add_batch(spark.createDataFrame([("b", "D_V", 1, 2)], SCHEMA), 1, folder)
    assert counts(totals(spark, folder)) == {("D_V", 1): 3}
    add_batch(spark.createDataFrame([], SCHEMA), 2, folder)
    assert latest(spark, folder) == 1


def test_marginals_in_one_aggregate(spark):
    rng = np.random.default_rng(1)
    rows = [("D_V" if k % 2 else "D_B", *map(int, rng.integers(0, 4, 4)), int(rng.integers(1, 9))) for k in range(300)]
    schema = "channel string, ell_bin int, theta_bin int, phi_bin int, sf_bin int, count long"
    hist = spark.createDataFrame(rows, schema).groupBy("channel", "ell_bin", "theta_bin", "phi_bin", "sf_bin").agg(F.sum("count").alias("count"))
    got = st.marginals(hist)
    plan = hist._jdf.queryExecution().executedPlan().toString().count("HashAggregate")
    assert got._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == plan + 2
    for keys in st.MARGINALS:
        want = {tuple(r) for r in hist.groupBy("channel", *keys).agg(F.sum("count")).collect()}
        assert {tuple(r) for r in got.where(F.col("over") == ",".join(keys)).select("channel", *keys, "count").collect()} == want


def test_demo_over_a_folder(spark, tmp_path):
    rng, folder = np.random.default_rng(6), tmp_path / "in"
    folder.mkdir()
    for name, n in (("slice_x3_0_beta1", 16), ("slice_x3_1_beta1", 16), ("slice_x1_0_beta1", 12)):
        np.savez(folder / f"{name}.npz", **{f: rng.normal(size=(n, n)) + 9 * (f == "dens") for f in SEVEN})
    (folder / "slice_x2_0_beta1.npz").write_bytes(b"junk" * 40)
    found = jobs.run_demo(spark, f"file://{folder}", str(tmp_path / "out"), n_disp_total=20, n_random_subsamples=20, n_ell_bins=2)
    assert sorted(k for k in found if not k.startswith("failed")) == ["batch_axis1_12x12", "batch_axis3_16x16", "curves", "list", "simple"]
    assert [k.rsplit("/", 1)[1] for k in found if k.startswith("failed")] == ["slice_x2_0_beta1.npz"]
    assert cf.read_result(spark, found["batch_axis3_16x16"], "run_meta").first()["meta"]["n_slices"] == "2"
    assert spark.read.parquet(found["curves"]).count() > 0 and jobs.read_simple(spark, found["simple"]).count() > 0
