"""Grids made from the order tables: a cell for each order, fields from order-independent aggregates of its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incrementa.functions.morton import encode
from incrementa.operators.displacements import scale_edges
from incrementa.operators.sampling import permuted_samples, with_scale
from incrementa.operators.volume import planar_derivatives
from incrementa.plans.analysis import with_derived

#: fixed values: the default displacements
DISPLACEMENTS = [(1, 0), (0, 1), (2, 1), (3, 3), (5, 2), (8, 8), (13, 4), (21, 20)]
SAMPLES = 1000
SCALE_BINS = 16
ELL = scale_edges(1, 61, SCALE_BINS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").count()


def plane_size(spark: SparkSession, sf_dir: str) -> int:
    """Rows and columns of the plane."""
    return int(orders_count(spark, sf_dir) ** 0.5)


def volume_size(spark: SparkSession, sf_dir: str) -> int:
    """Cells along an edge of the volume, even."""
    n, k = orders_count(spark, sf_dir), 1
    while (2 * (k + 1)) ** 3 <= n:
        k += 1
    return 2 * k


def _cells(spark: SparkSession, sf_dir: str, most: int) -> tuple[DataFrame, dict[str, Column]]:
    """Orders under ``most`` with their line aggregates, and the seven fields over them; an order without lines has v = B = 0."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") < most).groupBy("l_orderkey").agg(
        F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"), F.sum("l_partkey").alias("p"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum("l_suppkey").alias("s")
    )
    cells = table(spark, sf_dir, "orders").where(F.col("o_orderkey") < most).select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    p, q, s = (F.col(c) for c in "pqs")
    or_0 = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda total, m: (total % F.lit(m)) / F.lit(float(m)) - F.lit(0.5)
    fields = {
        "rho": F.lit(0.5) + F.col("o_totalprice") / F.lit(250000.0),
        "v_x": or_0((F.col("hi") - 50000.0) / 50000.0),
        "v_y": or_0(share(p * 7919, 10007)),
        "v_z": or_0(share(q * 104729 + s, 9973)),
        "b_x": or_0((F.col("lo") - 20000.0) / 20000.0),
        "b_y": or_0(share(s * 7907 + p, 10009)),
        "b_z": or_0(share(p * 31 + q * 17 + s * 13, 9967)),
    }
    return cells, fields


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(j, i, rho, v_*, b_*)."""
    n = plane_size(spark, sf_dir)
    cells, fields = _cells(spark, sf_dir, n * n)
    return cells.select(F.floor(F.col("o_orderkey") / F.lit(n)).cast("int").alias("j"), (F.col("o_orderkey") % F.lit(n)).cast("int").alias("i"), *(v.alias(k) for k, v in fields.items()))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane with in-plane derivatives, Alfven velocity and Elsasser fields: all 28."""
    return with_derived(planar_derivatives(plane(spark, sf_dir), plane_size(spark, sf_dir)))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, k, j, i, dens, velx.., bcc1..): eight meshblocks."""
    n = volume_size(spark, sf_dir)
    cells, f = _cells(spark, sf_dir, n**3)
    key = F.col("o_orderkey")
    names = dict(zip(["dens", "velx", "vely", "velz", "bcc1", "bcc2", "bcc3"], f.values()))
    at = cells.select(F.floor(key / F.lit(n * n)).cast("int").alias("k"), (F.floor(key / F.lit(n)) % n).cast("int").alias("j"), (key % F.lit(n)).cast("int").alias("i"), *(v.alias(c) for c, v in names.items()))
    half = n // 2
    block = lambda c: F.floor(F.col(c) / F.lit(half)).cast("int")
    return at.select(encode(block("i"), block("j"), block("k")).alias("gid"), "*")


def displacements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, di, dj) for k, (di, dj) in enumerate(DISPLACEMENTS)], "disp_id int, di int, dj int")


def scaled(spark: SparkSession) -> DataFrame:
    return with_scale(displacements(spark), ELL)


def samples(spark: SparkSession, sf_dir: str, n: int = SAMPLES) -> DataFrame:
    size = plane_size(spark, sf_dir)
    return permuted_samples(scaled(spark), size, size, n)
