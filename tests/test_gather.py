"""Points of a stencil by one join, against a lookup a point and numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from incrementa.operators import sampling as sm


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    rows, columns, names = 9, 7, ["a", "b"]
    data = {s: {f: rng.normal(size=(rows, columns)) for f in names} for s in ("one", "two")}
    data["one"]["a"][2, 3] = np.nan
    cells = [(s, j, i, *(float(data[s][f][j, i]) for f in names)) for s in data for j in range(rows) for i in range(columns)]
    grid = spark.createDataFrame(cells, "slice_id string, j int, i int, a double, b double")
    disp = spark.createDataFrame([(0, 1, 0), (1, 2, -3), (2, 7, 9)], "disp_id int, di int, dj int")
    return rows, columns, data, grid, sm.permuted_samples(disp, rows, columns, 40, 3)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", plan))


@pytest.mark.parametrize("width", [2, 3, 5])
def test_one_join_at_any_width(spark, made, width):
    rows, columns, data, grid, samples = made
    many = samples.crossJoin(spark.createDataFrame([("one",), ("two",)], "slice_id string"))
    out = sm.gather(many, grid, ["a", "b"], rows, columns, width)
    assert joins(out) == joins(many) + 1
    got = out.collect()
    assert len(got) == 3 * 40 * 2
    for r in got:
        for k in sm.stencil(width):
            for f in ("a", "b"):
                want = data[r.slice_id][f][(r.j + k * r.dj) % rows, (r.i + k * r.di) % columns]
                assert r[f"{f}__{k}"] == want or np.isnan(want) and np.isnan(r[f"{f}__{k}"])


def test_both_ways_agree(spark, made, monkeypatch):
    rows, columns, _, grid, samples = made
    one = grid.where("slice_id = 'one'").drop("slice_id")
    few = lambda df: sorted(map(repr, df.select("disp_id", "k", "j", "i", "a__-1", "a__0", "a__1", "b__0").collect()))
    small = sm.gather(samples, one, ["a", "b"], rows, columns, 3)
    monkeypatch.setattr(sm, "BROADCAST_BYTES", 10)
    large = sm.gather(samples, one, ["a", "b"], rows, columns, 3)
    assert joins(small) == 3 and joins(large) == 1 and few(small) == few(large)


def test_relation_size_is_no_less_than_sparks(spark):
    grid = spark.range(40000).select((F.col("id") / 200).cast("int").alias("j"), (F.col("id") % 200).cast("int").alias("i"), *(F.rand(k).alias(f"f{k}") for k in range(6)))
    left = spark.range(10).select((F.col("id") * 3).cast("int").alias("j"), F.col("id").cast("int").alias("i"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = left.join(F.broadcast(grid), ["j", "i"])
        df.collect()
        todo, found = [df._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("BroadcastExchange"):
                found.append(node.metrics().apply("dataSize").value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(found) == 1 and found[0] <= sm.relation_bytes(40000, 6) <= 3 * found[0], (found, sm.relation_bytes(40000, 6))
