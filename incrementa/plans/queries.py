"""Every registered query of the engine with its DuckDB oracle, by inventory id."""

from __future__ import annotations

import bisect
import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incrementa.functions import binning, morton, physics
from incrementa.functions.vectors import Vec, cross, dot, norm
from incrementa.operators import channels as ch
from incrementa.operators import displacements as ds
from incrementa.operators import sampling as sm
from incrementa.operators import statistics as st
from incrementa.operators import volume as vol
from incrementa.plans import fixtures as fx
from incrementa.plans import jobs
from incrementa.plans import oracle as o
from incrementa.plans.analysis import analyse_slice, framed_samples
from incrementa.sources import config as cf
from incrementa.sources import slices as sl
from incrementa.streaming.accumulate import accumulate, totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NAN = float("nan")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded: sums and transcendental functions differ in their last bits between engines."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_rounded(sql: str, columns: list[str], digits: int = 9) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({sql})"


P = o.with_(o.PLANE)
G = o.with_(o.PLANE, o.GRID)
S = o.BASE
FRAMED = f"{o.BASE}, {o.frames()}"
VB = [f"{v}_{c}" for v in "vb" for c in "xyz"]

# ---- sources and sinks -------------------------------------------------------------------------


def work(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; a temporary one only where all is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='incrementa-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_slices(spark: SparkSession, sf: str) -> str:
    """The list file of a run whose only slice is the plane, written under a slice's name."""
    folder = work(spark, "run")
    path = f"{folder}/slice_x3_0_beta25"
    fx.grid(spark, sf).select("j", "i", *sl.FIELDS.values()).withColumnsRenamed({v: k for k, v in sl.FIELDS.items()}).write.parquet(path)
    cf.write_slice_list(spark, [path], f"{folder}/list")
    return f"{folder}/list"


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The plane under its stored names, density as a whole number, without the derived fields."""
    back = {v: k for k, v in sl.FIELDS.items()}
    return fx.plane(spark, sf).withColumnsRenamed(back).withColumn("extra", F.lit(1))


@query("src_1", f"{P} SELECT j, i, rho, {', '.join(VB)}, count(*) OVER () AS cells FROM plane")
def src_1(spark, sf):
    df = sl.load_slice(stored(spark, sf)).select("j", "i", "rho", *VB)
    return df.crossJoin(df.agg(F.count("*").alias("cells")))


@query("src_2", f"{P} SELECT j, i, rho, {', '.join(VB)} FROM plane")
def src_2(spark, sf):
    return sl.canonical(stored(spark, sf)).select("j", "i", "rho", *VB)


@query("src_3", f"{P} SELECT CAST(j // 3 AS INTEGER) AS j, CAST(i // 3 AS INTEGER) AS i, rho FROM plane WHERE j % 3 = 0 AND i % 3 = 0")
def src_3(spark, sf):
    return sl.strided(fx.plane(spark, sf).select("j", "i", "rho"), 3)


@query("src_4", f"{P} SELECT j, i, rho, CAST('NaN' AS DOUBLE) AS omega_x, CAST('NaN' AS DOUBLE) AS grad_rho_z FROM plane")
def src_4(spark, sf):
    return sl.filled(fx.plane(spark, sf)).select("j", "i", "rho", "omega_x", "grad_rho_z")


@query("src_5", f"{P} SELECT j, i, CAST(j * i AS DOUBLE) AS rho FROM plane")
def src_5(spark, sf):
    return sl.as_double(fx.plane(spark, sf).select("j", "i", (F.col("j") * F.col("i")).alias("rho")))


#: a file name for each supplier: axis 0 to 4, of which 1 to 3 are axes, some in capitals, some without beta, some with an extractor's name
NAMED = """(SELECT CASE WHEN k % 6 = 0 THEN 'run_axis' || (1 + k % 3) || '_slice0_file' || lpad(CAST(k AS VARCHAR), 4, '0') WHEN k % 7 = 0 THEN 'slice_x' || (k % 5) || '_0_test' WHEN k % 4 = 0 THEN 'SLICE_X' || (k % 5) || '_' || nat || '.5_BETA' || (k % 11) || '.' || nat || '_final'
 ELSE 'slice_x' || (k % 5) || '_-0.' || nat || '_beta' || (k % 13) || '_data' END || '.npz' AS path FROM (SELECT s_suppkey AS k, s_nationkey AS nat FROM supplier))"""


def names(spark, sf):
    k, nat = F.col("s_suppkey"), F.col("s_nationkey")
    as_text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts), F.lit(".npz"))
    path = F.when(k % 6 == 0, as_text("run_axis", 1 + k % 3, "_slice0_file", F.lpad(k.cast("string"), 4, "0")))
    path = path.when(k % 7 == 0, as_text("slice_x", k % 5, "_0_test"))
    path = path.when(k % 4 == 0, as_text("SLICE_X", k % 5, "_", nat, ".5_BETA", k % 11, ".", nat, "_final"))
    return fx.table(spark, sf, "supplier").select(path.otherwise(as_text("slice_x", k % 5, "_-0.", nat, "_beta", k % 13, "_data")).alias("path"))


@query("src_7", f"""WITH r AS (SELECT path, regexp_extract(path, 'slice_x([123])_.*?_beta([0-9]+(\\.[0-9]+)?)', 1, 'i') AS a, regexp_extract(path, 'slice_x([123])_.*?_beta([0-9]+(\\.[0-9]+)?)', 2, 'i') AS b FROM {NAMED})
 SELECT path, CAST(CASE WHEN a <> '' THEN CAST(a AS INTEGER) ELSE -1 END AS INTEGER) AS axis, CASE WHEN b <> '' THEN CAST(b AS DOUBLE) ELSE -1e0 END AS beta FROM r""")  # fmt: skip
def src_7(spark, sf):
    axis, beta = sl.metadata(F.col("path"))
    return names(spark, sf).select("path", F.coalesce(axis, F.lit(-1)).alias("axis"), F.coalesce(beta, F.lit(-1.0)).alias("beta"))


@query("src_8", f"SELECT path FROM {NAMED}")
def src_8(spark, sf):
    """Paths of a list file on disk, with blanks around them and empty lines between."""
    lines = names(spark, sf).select(F.explode(F.array(F.concat(F.lit("  "), "path", F.lit("\t ")), F.lit("   "), F.lit(""))).alias("value"))
    path = work(spark, "list")
    lines.write.text(path)
    return sl.listed_paths(spark.read.text(path))


@query("src_9", f"SELECT path, CAST(CASE WHEN contains(path, 'axis1') THEN 1 WHEN contains(path, 'axis2') THEN 2 ELSE 3 END AS INTEGER) AS axis FROM {NAMED}")
def src_9(spark, sf):
    return names(spark, sf).select("path", sl.axis_by_name(F.col("path")).alias("axis"))


#: files of ranks, made from suppliers: rank by nation, name by key
FILES = "SELECT CAST(s_nationkey AS INTEGER) AS rank, 'f.' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '.bin' AS path FROM supplier"


def files(spark, sf):
    return fx.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("int").alias("rank"), F.concat(F.lit("f."), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit(".bin")).alias("path"))


@query("src_11", f"SELECT rank, max(path) AS path FROM ({FILES}) GROUP BY rank")
def src_11(spark, sf):
    return sl.latest_files(files(spark, sf))


@query("src_11_numbered", f"SELECT rank, path FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY path) - 1 AS k FROM ({FILES})) WHERE k = 2")
def src_11_numbered(spark, sf):
    return sl.latest_files(files(spark, sf), 2)


CODE = "regexp_replace(regexp_replace(printf('%.8f', {v}), '0+$', ''), '\\.$', '')"


@query("snk_1", f"SELECT o_orderkey, CASE WHEN c = '' THEN '0' ELSE c END AS code FROM (SELECT o_orderkey, translate({CODE.format(v='(o_orderkey - 700) / 64e0')}, '-.', 'mp') AS c  FROM orders)")
def snk_1(spark, sf):
    rows = fx.table(spark, sf, "orders")
    return rows.select("o_orderkey", sl.value_code((F.col("o_orderkey") - 700) / F.lit(64.0)).alias("code"))


# ---- volume ------------------------------------------------------------------------------------

VN = "vn AS (SELECT CAST(2 * max(k) AS BIGINT) AS n FROM (SELECT unnest(range(1, 2000)) AS k) WHERE 8 * k * k * k <= (SELECT count(*) FROM orders))"
MORTON = " + ".join(f"((({v} >> {k}) & 1) << {3 * k + p})" for k in range(morton.BITS) for p, v in enumerate(("a", "b", "c")))
UNMORTON = {p: " + ".join(f"(((m >> {3 * k + p}) & 1) << {k})" for k in range(morton.BITS)) for p in range(3)}
VOLUME = f"""{VN}, {o.LINES}, vc AS (SELECT CAST(o_orderkey // (n * n) AS INTEGER) AS k, CAST((o_orderkey // n) % n AS INTEGER) AS j, CAST(o_orderkey % n AS INTEGER) AS i, n,
 {o.SEVEN.format(*vol.PRIMITIVES)} FROM orders CROSS JOIN vn LEFT JOIN li ON l_orderkey = o_orderkey WHERE o_orderkey < n * n * n)"""
V = f"WITH {VOLUME}"
TRIPLES = "(SELECT CAST(o_orderkey % 64 AS INTEGER) AS a, CAST((o_orderkey // 64) % 64 AS INTEGER) AS b, CAST((o_orderkey * 7) % 64 AS INTEGER) AS c FROM orders)"


def triples(spark, sf):
    key = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select((key % 64).cast("int").alias("a"), (F.floor(key / F.lit(64)) % 64).cast("int").alias("b"), (key * 7 % 64).cast("int").alias("c"))


@query("vol_1", f"SELECT a, b, c, CAST({MORTON} AS INTEGER) AS code FROM {TRIPLES}")
def vol_1(spark, sf):
    return triples(spark, sf).select("*", morton.encode(F.col("a"), F.col("b"), F.col("c")).alias("code"))


@query("vol_2", f"SELECT m, CAST({UNMORTON[2]} AS INTEGER) AS i3, CAST({UNMORTON[1]} AS INTEGER) AS i2, CAST({UNMORTON[0]} AS INTEGER) AS i1 FROM (SELECT CAST(o_orderkey * 17 % 262144 AS INTEGER) AS m FROM orders)")
def vol_2(spark, sf):
    m = fx.table(spark, sf, "orders").select((F.col("o_orderkey") * 17 % 262144).cast("int").alias("m"))
    return m.select("m", *(v.alias(c) for c, v in zip(("i3", "i2", "i1"), morton.decode(F.col("m")))))


@query("vol_3", """WITH nb AS (SELECT count(*) AS n, count(*) // 24 AS q, count(*) % 24 AS m FROM supplier), g AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS gid FROM supplier)
SELECT gid, CAST(CASE WHEN gid < m * (q + 1) THEN gid // (q + 1) ELSE m + (gid - m * (q + 1)) // greatest(q, 1) END AS INTEGER) AS rank, CAST(CASE WHEN gid < m * (q + 1) THEN gid % (q + 1) ELSE (gid - m * (q + 1)) % greatest(q, 1) END AS INTEGER) AS place FROM g CROSS JOIN nb""")
def vol_3(spark, sf):
    """As many blocks as there are suppliers, dealt to 24 ranks."""
    n = fx.table(spark, sf, "supplier").count()
    rank, place = morton.rank_of(F.col("gid"), n, 24)
    return spark.range(n).select(F.col("id").cast("int").alias("gid")).select("gid", rank.alias("rank"), place.alias("place"))


BLOCKS = f"""blocks AS (SELECT CAST({MORTON.replace('(a ', '(bi ').replace('(b ', '(bj ').replace('(c ', '(bk ')} AS INTEGER) AS gid, -0.5e0 + bi * 0.5e0 AS lo_1, -0.5e0 + bi * 0.5e0 + 0.5e0 AS hi_1, -0.5e0 + bj * 0.5e0 AS lo_2, -0.5e0 + bj * 0.5e0 + 0.5e0 AS hi_2, -0.5e0 + bk * 0.5e0 AS lo_3, -0.5e0 + bk * 0.5e0 + 0.5e0 AS hi_3
 FROM (SELECT unnest(range(2)) AS bi) CROSS JOIN (SELECT unnest(range(2)) AS bj) CROSS JOIN (SELECT unnest(range(2)) AS bk))"""


def stored_volume(spark, sf) -> tuple[str, int, int]:
    """(path, cells along a block, cells along the box) of the volume, stored by meshblock."""
    n, path = fx.volume_size(spark, sf), work(spark, "volume")
    vol.store_volume(fx.volume(spark, sf), path, n // 2, n)
    return path, n // 2, n


@query("vol_4", f"WITH {BLOCKS} SELECT * FROM blocks")
def vol_4(spark, sf):
    """Extents of the volume's meshblocks."""
    n = fx.volume_size(spark, sf)
    return vol.layout(fx.volume(spark, sf).select("gid").distinct(), n // 2, n).drop("at_1", "at_2", "at_3")


@query("vol_5", f"WITH {BLOCKS}, {VOLUME} SELECT gid, k, j, i, dens FROM vc JOIN blocks ON lo_1 = -0.5e0 + 0.5e0 * (i // (n // 2)) AND lo_2 = -0.5e0 + 0.5e0 * (j // (n // 2)) AND lo_3 = -0.5e0 + 0.5e0 * (k // (n // 2)) WHERE lo_2 <= -0.25e0 AND hi_2 >= -0.25e0")
def vol_5(spark, sf):
    """Cells of the stored meshblocks whose extent holds a position; no other block is read."""
    path, size, n = stored_volume(spark, sf)
    wanted = vol.blocks_of(spark.read.parquet(f"{path}/layout"), 2, -0.25).select("gid")
    return vol.stored_cells(spark, path).join(F.broadcast(wanted), "gid", "left_semi").select("gid", "k", "j", "i", "dens")


@query("vol_6", "WITH v AS (SELECT o_orderkey AS id, (o_orderkey % 101) / 100e0 - 0.5e0 AS value FROM orders), f AS (SELECT list_transform(range(25), lambda k: -0.5e0 + k / 24e0) AS faces) SELECT id, value, CAST(CASE WHEN c BETWEEN 0 AND 23 THEN c END AS INTEGER) AS idx FROM (SELECT id, value, len(list_filter(faces, lambda x: x < value)) - 1 AS c FROM v CROSS JOIN f)")
def vol_6(spark, sf):
    """The cell of 24 that holds a position, for as many positions as there are orders; faces are among them."""
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 101) / F.lit(100.0) - 0.5).alias("value"))
    return rows.select("id", "value", morton.cell_of(F.col("value"), 24).alias("idx"))


for _axis, (_n, _r, _c) in vol.LAYOUT.items():

    def _plane(spark, sf, axis=_axis):
        return vol.plane(fx.volume(spark, sf), axis, 3)

    query(f"vol_7_axis{_axis}", f"{V} SELECT {_r} AS j, {_c} AS i, {', '.join(vol.PRIMITIVES)} FROM vc WHERE {_n} = 3")(_plane)


@query("vol_8", f"{V} SELECT a.j AS j, a.i AS i, a.dens AS dens, p.dens AS dens_p, m.dens AS dens_m FROM vc a JOIN vc p ON p.k = 1 AND p.j = a.j AND p.i = a.i JOIN vc m ON m.k = a.n - 1 AND m.j = a.j AND m.i = a.i WHERE a.k = 0")
def vol_8(spark, sf):
    return vol.with_neighbour_planes(fx.volume(spark, sf), 3, 0, fx.volume_size(spark, sf), ["dens"])


def slice_sql(axis: int, at: str = "3") -> str:
    """The slice at cell ``at`` (3) along ``axis`` with its derived fields, by six self-joins."""
    normal, row, col = vol.LAYOUT[axis]
    which = dict(zip("xyz", "ijk"))
    steps = {"ip": ("i", 1), "im": ("i", -1), "jp": ("j", 1), "jm": ("j", -1), "kp": ("k", 1), "km": ("k", -1)}
    joins = " ".join("JOIN u {t} ON ".replace("{t}", t) + " AND ".join(f"{t}.{x} = " + (f"(a.{x} + {s} + a.n) % a.n" if x == c else f"a.{x}") for x in "kji") for t, (c, s) in steps.items())
    d = lambda f, x: f"({which[x]}p.{f} - {which[x]}m.{f}) / (2e0 / a.n)"
    rot = lambda n: {"x": f"{d(n[2], 'y')} - {d(n[1], 'z')}", "y": f"{d(n[0], 'z')} - {d(n[2], 'x')}", "z": f"{d(n[1], 'x')} - {d(n[0], 'y')}"}
    out = {f"vort{c}": e for c, e in rot(["velx", "vely", "velz"]).items()} | {f"curr{c}": e for c, e in rot(["bcc1", "bcc2", "bcc3"]).items()}
    out |= {f"curv{c}": f"a.unit1 * ({d(f'unit{k}', 'x')}) + a.unit2 * ({d(f'unit{k}', 'y')}) + a.unit3 * ({d(f'unit{k}', 'z')})" for k, c in enumerate("xyz", 1)}
    out |= {f"grad_rho_{c}": d("dens", c) for c in "xyz"}
    unit = ", ".join(f"bcc{k} / sqrt(bcc1 * bcc1 + bcc2 * bcc2 + bcc3 * bcc3 + 1e-10) AS unit{k}" for k in (1, 2, 3))
    return f"{V}, u AS (SELECT *, {unit} FROM vc) SELECT a.{row} AS j, a.{col} AS i, {', '.join(f'a.{p} AS {p}' for p in vol.PRIMITIVES)}, {', '.join(f'{e} AS {c}' for c, e in out.items())} FROM u a {joins} WHERE a.{normal} = {at}"


def extracted(spark, sf, axis):
    n = fx.volume_size(spark, sf)
    return vol.extract_slice(fx.volume(spark, sf), axis, -0.5 + 3.5 / n, n)


def _part(name: str, axis: int, columns: list[str]) -> None:
    full = slice_sql(axis)
    query(name, f"SELECT j, i, {', '.join(columns)} FROM ({full})")(lambda spark, sf: extracted(spark, sf, axis).select("j", "i", *columns))


SLICE_FIELDS = [*vol.PRIMITIVES, *(f"{v}{c}" for v in ("vort", "curr", "curv", "grad_rho_") for c in "xyz")]


def extracted_stored(spark, sf):
    """The slice of a stored volume: only the meshblocks about the plane are read."""
    path, size, n = stored_volume(spark, sf)
    return vol.extract_stored(spark, path, 2, -0.5 + 3.5 / n, size, n).select("j", "i", *SLICE_FIELDS)


_part("vol_9", 3, ["grad_rho_x", "grad_rho_y"])
_part("vol_10", 3, ["grad_rho_z"])
for _axis in (1, 2, 3):
    _part(f"vol_11_axis{_axis}", _axis, ["vortx", "vorty", "vortz"])
_part("vol_12", 2, ["currx", "curry", "currz"])
_part("vol_14", 1, ["curvx", "curvy", "curvz"])
_part("vol_15", 1, ["grad_rho_x", "grad_rho_y", "grad_rho_z"])
_part("vol_16", 2, SLICE_FIELDS)
query("vol_16_stored", f"SELECT j, i, {', '.join(SLICE_FIELDS)} FROM ({slice_sql(2)})")(extracted_stored)


@query("vol_13", f"{V} SELECT j, i, " + ", ".join(f"bcc{k} / sqrt(bcc1 * bcc1 + bcc2 * bcc2 + bcc3 * bcc3 + 1e-10) AS unit{k}" for k in (1, 2, 3)) + " FROM vc WHERE k = 2")
def vol_13(spark, sf):
    three = vol.with_neighbour_planes(fx.volume(spark, sf), 3, 2, fx.volume_size(spark, sf))
    return vol.unit_fields(three).select("j", "i", "unit1", "unit2", "unit3")


# ---- physics -----------------------------------------------------------------------------------

BAD = f"{P}, bad AS (SELECT * REPLACE (CASE WHEN (j * 131 + i) % 97 = 0 THEN 1e0 - j ELSE rho END AS rho, CASE WHEN (j * 131 + i) % 101 = 0 THEN CAST('NaN' AS DOUBLE) ELSE v_x END AS v_x, CASE WHEN (j * 131 + i) % 103 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE v_y END AS v_y) FROM plane)"
VA_SQL = ", ".join(f"CASE WHEN rho > 0 THEN b_{c} * (1e0 / sqrt(greatest(rho, 1e-10))) ELSE 0e0 END AS va_{c}" for c in "xyz")


def bad_plane(spark, sf):
    """The plane with densities that are not positive, NaN and infinite velocities."""
    k = F.col("j") * 131 + F.col("i")
    return fx.plane(spark, sf).withColumns({
        "rho": F.when(k % 97 == 0, F.lit(1.0) - F.col("j")).otherwise(F.col("rho")),
        "v_x": F.when(k % 101 == 0, F.lit(NAN)).otherwise(F.col("v_x")),
        "v_y": F.when(k % 103 == 0, F.lit(float("inf"))).otherwise(F.col("v_y")),
    })


@query("phy_1", f"{BAD} SELECT j, i, {VA_SQL} FROM bad")
def phy_1(spark, sf):
    return physics.alfven(bad_plane(spark, sf)).select("j", "i", "va_x", "va_y", "va_z")


@query("phy_2", f"{BAD}, a AS (SELECT *, {VA_SQL} FROM bad) SELECT j, i, {', '.join(f'v_{c} + va_{c} AS zp_{c}, v_{c} - va_{c} AS zm_{c}' for c in 'xyz')} FROM a")
def phy_2(spark, sf):
    return physics.elsasser(physics.alfven(bad_plane(spark, sf))).select("j", "i", *(f"{z}_{c}" for c in "xyz" for z in ("zp", "zm")))


@query("phy_3", f"{BAD} SELECT CAST(count_if(rho <= 0) AS BIGINT) AS n_bad, min(rho) AS rho_min FROM bad")
def phy_3(spark, sf):
    return physics.density_report(bad_plane(spark, sf))


@query("phy_4", f"{BAD} " + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(count_if(isnan({c})) AS BIGINT) AS n_nan, CAST(count_if(isinf({c})) AS BIGINT) AS n_inf FROM bad" for c in ("v_x", "v_y", "b_z")))
def phy_4(spark, sf):
    return physics.finite_report(bad_plane(spark, sf), ["v_x", "v_y", "b_z"])


@query("phy_6", f"{G} SELECT j, i, {', '.join(f'{o.length(v)} AS {v}' for v in ('v', 'b', 'va', 'zp', 'zm')).replace(' AS j', ' AS jj')} FROM grid")
def phy_6(spark, sf):
    return fx.grid(spark, sf).select("j", "i", *(physics.magnitude(v).alias(v) for v in ("v", "b", "va", "zp", "zm")))


# ---- displacements -----------------------------------------------------------------------------

RAW = "raw AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS bin, CAST((o_orderkey * 7919) % 41 - 20 AS INTEGER) AS dx, CAST((o_orderkey * 104729) % 23 - 11 AS INTEGER) AS dy FROM orders)"
FLIP = "CASE WHEN dx < 0 OR (dx = 0 AND dy < 0) THEN -{c} ELSE {c} END"
CANON = f"canon AS (SELECT {FLIP.format(c='dx')} AS dx, {FLIP.format(c='dy')} AS dy FROM (SELECT DISTINCT bin, dx, dy FROM raw WHERE dx <> 0 OR dy <> 0))"
EDGES_DEFAULT = fx.ELL


def raw_vectors(spark, sf):
    key = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select((key % 5).cast("int").alias("bin"), (key * 7919 % 41 - 20).cast("int").alias("dx"), (key * 104729 % 23 - 11).cast("int").alias("dy"))


#: fixed values: the scale edges of 1 to 38 in eight bins
EIGHT = [1.0, 2.0, 3.0, 5.0, 8.0, 11.0, 17.0, 25.0, 38.0]


@query("dsp_1", f"{P} SELECT ell_bin, ({o.edges_list(EIGHT)})[ell_bin + 1] AS edge, n FROM (SELECT ell_bin, count(*) AS n FROM (SELECT {o.bin_of('sqrt(CAST(j * j + i * i AS DOUBLE))', EIGHT)} AS ell_bin FROM plane) WHERE ell_bin >= 0 GROUP BY ell_bin)")
def dsp_1(spark, sf):
    """Cells of the plane by scale bin of their distance from its corner, with the bin's lower edge."""
    edges = ds.scale_edges(1, 38, 8)
    r = F.sqrt((F.col("j") * F.col("j") + F.col("i") * F.col("i")).cast("double"))
    rows = fx.plane(spark, sf).select(binning.bin_index(r, edges).alias("ell_bin")).where("ell_bin >= 0").groupBy("ell_bin").agg(F.count("*").alias("n"))
    return rows.select("ell_bin", F.get(F.array(*map(F.lit, edges)), F.col("ell_bin")).alias("edge"), "n")


@query("dsp_2", "SELECT CAST(w AS INTEGER) AS width, CAST(n // d AS INTEGER) AS ell_max FROM (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM orders) CROSS JOIN (VALUES (2, 2), (3, 4), (5, 8)) AS t(w, d)")
def dsp_2(spark, sf):
    n = fx.table(spark, sf, "orders").agg(F.floor(F.sqrt(F.count("*"))).alias("n"))
    return n.select("n", F.explode(F.array(*map(F.lit, (2, 3, 5)))).alias("width")).select("width", ds.largest_scale_of(F.col("n"), F.col("width")).alias("ell_max"))


@query("dsp_3", "SELECT o_orderkey, CAST(CASE WHEN t > 0 AND b > 0 THEN greatest(1, t // b) END AS INTEGER) AS quota FROM (SELECT o_orderkey, o_orderkey % 4001 AS t, o_custkey % 129 AS b FROM orders)")
def dsp_3(spark, sf):
    rows = fx.table(spark, sf, "orders")
    return rows.select("o_orderkey", ds.quota_of(F.col("o_orderkey") % 4001, F.col("o_custkey") % 129).alias("quota"))


def drawn_sql(seed: int) -> str:
    """CTE ``cand``: as many candidates a scale bin as orders allow, by seed, bin and number."""
    mix = (48271, 16807)
    bin_key = o.stirred(f"(bin + 1) * {mix[0]} % 2147483647", str(seed))
    e = o.edges_list(EDGES_DEFAULT)
    return f"""q AS (SELECT greatest(1, count(*) // {len(EDGES_DEFAULT) - 1}) AS q FROM orders), b AS (SELECT bin, unnest(range(q)) AS k, q, {bin_key} AS drawn FROM q CROSS JOIN (SELECT unnest(range({len(EDGES_DEFAULT) - 1})) AS bin)),
 a AS (SELECT bin, k, q, ({o.stirred(f"(k + 1) * {mix[1]} % 2147483647", "drawn")}) / 2147483647e0 * {math.pi!r}e0 AS angle, ({e})[bin + 1] AS lo, ({e})[bin + 2] AS hi FROM b),
 cand AS (SELECT CAST(bin AS INTEGER) AS bin, CAST(k AS INTEGER) AS k, CAST(round_even(r * cos(angle), 0) AS INTEGER) AS dx, CAST(round_even(r * sin(angle), 0) AS INTEGER) AS dy FROM (SELECT *, lo * exp(ln(hi / lo) * k / greatest(q - 1, 1)) AS r FROM a))"""


@query("dsp_4", f"WITH {drawn_sql(42)} SELECT bin, k, dx, dy FROM cand")
def dsp_4(spark, sf):
    """As many candidates as there are orders."""
    return ds.candidates(spark, EDGES_DEFAULT, fx.orders_count(spark, sf), 42)


@query("dsp_5", f"WITH {RAW} SELECT DISTINCT bin, dx, dy FROM raw")
def dsp_5(spark, sf):
    return ds.distinct_in_bin(raw_vectors(spark, sf))


@query("dsp_6", f"WITH {RAW} SELECT bin, dx, dy FROM raw WHERE dx <> 0 OR dy <> 0")
def dsp_6(spark, sf):
    return ds.without_zero(raw_vectors(spark, sf))


@query("dsp_7", f"WITH {RAW} SELECT bin, dx, dy FROM raw WHERE bin < 2 UNION ALL SELECT bin, dx, dy FROM raw WHERE bin >= 2")
def dsp_7(spark, sf):
    raw = raw_vectors(spark, sf)
    return raw.where("bin < 2").unionByName(raw.where("bin >= 2"))


@query("dsp_8", f"WITH {RAW} SELECT bin, {FLIP.format(c='dx')} AS dx, {FLIP.format(c='dy')} AS dy FROM raw")
def dsp_8(spark, sf):
    return ds.canonical(raw_vectors(spark, sf))


@query("dsp_9", f"WITH {RAW}, {CANON} SELECT DISTINCT dx, dy FROM canon")
def dsp_9(spark, sf):
    return ds.canonical(ds.without_zero(ds.distinct_in_bin(raw_vectors(spark, sf)))).select("dx", "dy").distinct()


@query("dsp_10", f"WITH {RAW}, {CANON} SELECT CAST(row_number() OVER (ORDER BY dx * dx + dy * dy, dx, dy) - 1 AS INTEGER) AS disp_id, dx AS di, dy AS dj FROM (SELECT DISTINCT dx, dy FROM canon)")
def dsp_10(spark, sf):
    return ds.numbered(dsp_9(spark, sf))


@query("dsp_11", f"WITH {drawn_sql(42)}, canon AS (SELECT DISTINCT {FLIP.format(c='dx')} AS dx, {FLIP.format(c='dy')} AS dy FROM cand WHERE dx <> 0 OR dy <> 0) SELECT CAST(row_number() OVER (ORDER BY dx * dx + dy * dy, dx, dy) - 1 AS INTEGER) AS disp_id, dx AS di, dy AS dj FROM canon")
def dsp_11(spark, sf):
    return ds.displacement_list(spark, EDGES_DEFAULT, fx.orders_count(spark, sf), 42)


# ---- samples and stencils ----------------------------------------------------------------------


@query("smp_1", f"{S} SELECT disp_id, k, j, i FROM samp")
def smp_1(spark, sf):
    return fx.samples(spark, sf).select("disp_id", "k", "j", "i")


@query("smp_1_affine", f"{o.BASE_AFFINE} SELECT disp_id, k, j, i FROM samp")
def smp_1_affine(spark, sf):
    n = fx.plane_size(spark, sf)
    return sm.affine_samples(fx.scaled(spark), n, n, fx.SAMPLES).select("disp_id", "k", "j", "i")


@query("smp_1_seeded", f"{o.with_(o.NN, o.DISP, o.SCALED, o.permuted('least(4000, n * n)', 7))} SELECT disp_id, k, j, i FROM samp")
def smp_1_seeded(spark, sf):
    n = fx.plane_size(spark, sf)
    return sm.permuted_samples(fx.scaled(spark), n, n, min(4000, n * n), 7).select("disp_id", "k", "j", "i")


@query("smp_1_random", f"WITH {o.NN}, {o.DISP}, {o.SCALED} SELECT disp_id, n * n AS n, n * n AS cells, true AS inside FROM scaled CROSS JOIN nn")
def smp_1_random(spark, sf):
    """Every cell once, whatever the displacement: what a draw without replacement comes to when all are drawn."""
    n = fx.plane_size(spark, sf)
    drawn = sm.permuted_samples(fx.scaled(spark), n, n, n * n, 11).select("disp_id", "j", "i")
    # no place recurs, so that combining within tasks saves nothing: rows go to as many tasks as they need before they are counted
    drawn = drawn.repartition(sm.sample_tasks(spark, n * n), "disp_id", "j", "i")
    inside = F.min((F.col("j").between(0, n - 1)) & (F.col("i").between(0, n - 1)))
    return drawn.groupBy("disp_id").agg(F.count("*").alias("n"), F.countDistinct("j", "i").alias("cells"), inside.alias("inside"))


@query("smp_2", f"{P} SELECT j * n + i AS pos, CAST((j * n + i) // n AS INTEGER) AS j, CAST((j * n + i) % n AS INTEGER) AS i FROM plane CROSS JOIN nn")
def smp_2(spark, sf):
    n = fx.plane_size(spark, sf)
    flat = fx.plane(spark, sf).select((F.col("j").cast("long") * n + F.col("i")).alias("pos"))
    return sm.positions(flat, n).select("pos", "j", "i")


@query("smp_3", f"WITH {o.NN}, {o.DISP} SELECT disp_id, count(*) AS n FROM disp CROSS JOIN orders CROSS JOIN nn WHERE o_orderkey < n * n GROUP BY disp_id")
def smp_3(spark, sf):
    return sm.every_position(fx.displacements(spark), fx.plane(spark, sf)).groupBy("disp_id").agg(F.count("*").alias("n"))


def gathered(spark, sf, fields, width=2):
    n = fx.plane_size(spark, sf)
    return sm.gather(fx.samples(spark, sf), fx.grid(spark, sf), fields, n, n, width)


@query("stn_1", f"{S}, {o.GRID} SELECT s.disp_id, s.k, g0.rho AS here, g1.rho AS there {o.stencil_joins(2)}".replace(o.SAMP + f", {o.GRID}", o.SAMP))
def stn_1(spark, sf):
    return gathered(spark, sf, ["rho"]).select("disp_id", "k", F.col("rho__0").alias("here"), F.col("rho__1").alias("there"))


def _stencil(name: str, width: int, fields: list[str]) -> None:
    sql = f"{S} SELECT s.disp_id, s.k, {', '.join(f'{o.diff(f, width)} AS d_{f}' for f in fields)} {o.stencil_joins(width)}"
    query(name, sql)(lambda spark, sf: gathered(spark, sf, fields, width).select("disp_id", "k", *(sm.increment(f, width).alias(f"d_{f}") for f in fields)))


_stencil("stn_2", 2, ["v_x", "v_y", "v_z", "rho"])
_stencil("stn_3", 3, ["v_x", "b_y", "rho"])
_stencil("stn_4", 5, ["v_x", "b_y", "rho"])
for _w in (2, 3, 5):
    query(f"stn_5_width{_w}", f"{S} SELECT s.disp_id, s.k, {', '.join(f'{o.mean('b_' + c, _w)} AS m_{c}' for c in 'xyz')} {o.stencil_joins(_w)}")(
        lambda spark, sf, w=_w: gathered(spark, sf, ["b_x", "b_y", "b_z"], w).select("disp_id", "k", *(sm.stencil_mean(f"b_{c}", w).alias(f"m_{c}") for c in "xyz"))
    )


#: the canonical displacements that the orders give
OWN = f"WITH {RAW}, {CANON}, own AS (SELECT CAST(row_number() OVER (ORDER BY dx * dx + dy * dy, dx, dy) - 1 AS INTEGER) AS disp_id, dx AS di, dy AS dj FROM (SELECT DISTINCT dx, dy FROM canon))"
OWN_SCALED = f"{OWN}, dr AS (SELECT *, sqrt(CAST(di * di + dj * dj AS DOUBLE)) AS r FROM own), scaled AS (SELECT *, {o.bin_of('r', EIGHT)} AS ell_bin FROM dr WHERE {o.bin_of('r', EIGHT)} >= 0)"


@query("stn_7", f"{OWN} " + " UNION ALL ".join(f"SELECT {a} AS axis, disp_id, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST({z} AS DOUBLE) AS z FROM own" for a, x, y, z in ((1, 0, "di", "dj"), (2, "di", 0, "dj"), (3, "di", "dj", 0))))
def stn_7(spark, sf):
    parts = [dsp_10(spark, sf).select(F.lit(a).alias("axis"), "disp_id", *(v.alias(c) for c, v in zip("xyz", sm.displacement_vector(a)))) for a in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_stencil("stn_8", 2, o.FIELDS)


@query("stn_9", f"{OWN_SCALED} SELECT disp_id, r, ell_bin FROM scaled")
def stn_9(spark, sf):
    return sm.with_scale(dsp_10(spark, sf), EIGHT).select("disp_id", "r", "ell_bin")


# ---- local frame and channels ------------------------------------------------------------------

ALL = [*ch.MAGNITUDES, *ch.PRODUCTS]


def inc(spark, sf, names, width=2):
    keep = ["disp_id", "di", "dj", "r", "ell_bin", "k"]
    vectors = ch.vectors_of(names)
    return ch.increments(gathered(spark, sf, ch.vector_columns(vectors), width), vectors, keep, width), keep


def in_frame(spark, sf, names, axis=3):
    rows, keep = inc(spark, sf, names)
    return ch.local_frame(rows, axis, keep)


def framed(spark, sf, names=None, axis=3, width=2):
    n = fx.plane_size(spark, sf)
    return framed_samples(fx.grid(spark, sf), fx.samples(spark, sf), n, n, axis, width, names)


@query("geo_1", f"{FRAMED} SELECT disp_id, count(*) AS kept FROM f2 GROUP BY disp_id")
def geo_1(spark, sf):
    return in_frame(spark, sf, ["D_B"]).groupBy("disp_id").agg(F.count("*").alias("kept"))


@query("geo_2", f"{FRAMED} SELECT disp_id, k, round(theta, 9) AS theta FROM f5")
def geo_2(spark, sf):
    return rounded(in_frame(spark, sf, ["D_B"]).select("disp_id", "k", "theta"))


@query("geo_3", f"{FRAMED} SELECT disp_id, k, q_v_x, q_v_y, q_v_z FROM f3")
def geo_3(spark, sf):
    return in_frame(spark, sf, ["D_V"]).select("disp_id", "k", *(v.alias(f"q_v_{c}") for c, v in zip("xyz", ch.perpendicular("v"))))


@query("geo_4", f"{FRAMED} SELECT disp_id, k, round(e_x, 9) AS e_x, round(e_y, 9) AS e_y, round(e_z, 9) AS e_z FROM f3")
def geo_4(spark, sf):
    rows, keep = inc(spark, sf, ["D_B"])
    return rounded(ch.local_frame(rows, 3, keep, whole=True).select("disp_id", "k", "e_x", "e_y", "e_z"))


@query("geo_5", f"{FRAMED} SELECT disp_id, k, round(phi, 9) AS phi FROM f5")
def geo_5(spark, sf):
    return rounded(in_frame(spark, sf, ["D_B"]).select("disp_id", "k", "phi"))


PERP = ["v", "b", "va", "omega", "j"]


@query("geo_6", f"{FRAMED} SELECT disp_id, k, " + ", ".join(f"{o.length('q_' + v)} AS p_{v}" for v in PERP) + " FROM f3")
def geo_6(spark, sf):
    return in_frame(spark, sf, ALL).select("disp_id", "k", *(norm(ch.perpendicular(v)).alias(f"p_{v}") for v in PERP))


@query("geo_7", f"{FRAMED} SELECT disp_id, k, {o.crossed('d_v', 'd_b')} AS size FROM f3")
def geo_7(spark, sf):
    return in_frame(spark, sf, ["D_V"]).select("disp_id", "k", norm(cross(Vec.of("d_v"), Vec.of("d_b"))).alias("size"))


@query("geo_8", f"{FRAMED} SELECT theta_bin, phi_bin, count(*) AS kept FROM framed GROUP BY ALL")
def geo_8(spark, sf):
    return framed(spark, sf, ["D_B"]).groupBy("theta_bin", "phi_bin").agg(F.count("*").alias("kept"))


#: fixed values: ids of the channels by their numbers, which for products is not the order of the list
NUMBERS = dict(enumerate(ch.MAGNITUDES)) | dict(zip([*range(10, 22), 23, 24, 25, 26, 22, 27], ch.PRODUCTS))


def _channel(number: int, name: str) -> None:
    if name in ch.MAGNITUDES:
        sql = f"{FRAMED}, {o.hist([name])} SELECT ell_bin, theta_bin, phi_bin, sf_bin, count FROM hist"
        query(f"ch_{number:02d}", sql)(lambda spark, sf: ch.magnitude_histogram(framed(spark, sf, [name]), [name]).drop("channel"))
    else:
        sql = f"{FRAMED}, {o.prod([name])} SELECT ell_bin, product_bin, count FROM prod"
        query(f"ch_{number:02d}", sql)(lambda spark, sf: ch.product_histogram(framed(spark, sf, [name]), [name]).drop("channel"))


for _k, _name in NUMBERS.items():
    _channel(_k, _name)

# ---- bins --------------------------------------------------------------------------------------

VALUES = "vals AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE o_totalprice / 40000e0 END AS v FROM orders)"


def values(spark, sf):
    key = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(key.alias("id"), F.when(key % 11 == 0, F.lit(NAN)).when(key % 13 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 40000.0).alias("v"))


@query("bin_1", f"WITH {VALUES} SELECT id, {o.bin_of('v', [0.5, 1.0, 2.0, 7.5])} AS bin FROM vals")
def bin_1(spark, sf):
    return values(spark, sf).select("id", binning.bin_index(F.col("v"), [0.5, 1.0, 2.0, 7.5]).alias("bin"))


@query("bin_2", f"{OWN_SCALED} SELECT ell_bin, count(*) AS n FROM scaled GROUP BY ell_bin")
def bin_2(spark, sf):
    return sm.with_scale(dsp_10(spark, sf), EIGHT).groupBy("ell_bin").agg(F.count("*").alias("n"))


@query("bin_3", f"WITH {VALUES} SELECT id, {o.bin_of('v', binning.theta_edges())} AS theta_bin, {o.bin_of('v', binning.phi_edges())} AS phi_bin FROM vals")
def bin_3(spark, sf):
    return values(spark, sf).select("id", binning.even_bin(F.col("v"), binning.theta_edges()).alias("theta_bin"), binning.even_bin(F.col("v"), binning.phi_edges()).alias("phi_bin"))


@query("bin_4", f"WITH {VALUES} SELECT id, {o.bin_of('v', binning.value_edges())} AS sf_bin, {o.bin_of('v', binning.product_edges())} AS product_bin FROM vals")
def bin_4(spark, sf):
    return values(spark, sf).select("id", binning.log_bin(F.col("v"), binning.value_edges()).alias("sf_bin"), binning.log_bin(F.col("v"), binning.product_edges()).alias("product_bin"))


@query("bin_5", f"WITH {VALUES} SELECT id, round(0.5e0 * (e[k + 1] + e[k + 2]), 12) AS center FROM (SELECT id, {o.bin_of('v', binning.value_edges())} AS k, {o.edges_list(binning.value_edges())} AS e FROM vals) WHERE k >= 0")
def bin_5(spark, sf):
    """The centre of each value's bin."""
    rows = values(spark, sf).select("id", binning.centre_of(binning.log_bin(F.col("v"), binning.value_edges()), binning.value_edges()).alias("center"))
    return rounded(rows.where("center is not null"), 12)


RAW_INC = f"rawinc AS (SELECT s.disp_id, s.r, " + ", ".join("sqrt(" + " + ".join(f"(g1.{v}_{c} - g0.{v}_{c}) * (g1.{v}_{c} - g0.{v}_{c})" for c in "xyz") + f") AS d{v}" for v in "vb") + f", abs(g1.rho - g0.rho) AS drho, s.k {o.stencil_joins(2)})"
RAWS = f"{S}, {RAW_INC}"


def raw(spark, sf):
    return st.raw_increments(gathered(spark, sf, ch.vector_columns(["rho", "v", "b"])))


#: fixed values: the scales of the default displacements
R_LO, R_HI = 1.0, math.sqrt(21 * 21 + 20 * 20)
PLOT_EDGES = [R_LO, *(R_LO * (R_HI / R_LO) ** (k / 19) for k in range(1, 19)), R_HI]


@query("bin_6", f"{RAWS} SELECT r_bin, count(*) AS n FROM (SELECT {o.bin_of('r', PLOT_EDGES)} AS r_bin FROM rawinc) WHERE r_bin >= 0 GROUP BY r_bin")
def bin_6(spark, sf):
    rows = raw(spark, sf)
    return rows.select(binning.bin_index(F.col("r"), st.plot_scales(rows)).alias("r_bin")).where("r_bin >= 0").groupBy("r_bin").agg(F.count("*").alias("n"))


@query("bin_7", f"{RAWS}, lim AS (SELECT min(dv) AS lo, max(dv) AS hi, count(*) AS total FROM rawinc) SELECT pdf_bin, n, round(n / (total * ((hi - lo) / 50e0)), 9) AS density FROM (SELECT CAST(least(floor((dv - lo) / (hi - lo) * 50e0), 49) AS INTEGER) AS pdf_bin, count(*) AS n FROM rawinc CROSS JOIN lim GROUP BY 1) CROSS JOIN lim")
def bin_7(spark, sf):
    return rounded(st.density(raw(spark, sf), "dv"))


# ---- aggregates --------------------------------------------------------------------------------

H = f"{FRAMED}, {o.hist(list(ch.MAGNITUDES))}"
PR = f"{FRAMED}, {o.prod(list(ch.PRODUCTS))}"


def hist(spark, sf, names=None):
    return ch.magnitude_histogram(framed(spark, sf, names), names)


def prod(spark, sf, names=None):
    return ch.product_histogram(framed(spark, sf, names), names)


@query("agg_1", f"{H} SELECT * FROM hist")
def agg_1(spark, sf):
    return hist(spark, sf, list(ch.MAGNITUDES))


@query("agg_2", f"{PR} SELECT * FROM prod")
def agg_2(spark, sf):
    return prod(spark, sf, list(ch.PRODUCTS))


@query("agg_3", f"{FRAMED}, {o.hist(['D_B'])} SELECT * FROM hist")
def agg_3(spark, sf):
    return st.merged([ch.magnitude_histogram(framed(spark, sf, ["D_B"]).where(F.col("disp_id") % 2 == w), ["D_B"]) for w in (0, 1)])


@query("agg_4", f"{FRAMED}, {o.hist(['D_V', 'D_RHO'])} SELECT * FROM hist")
def agg_4(spark, sf):
    parts = [ch.magnitude_histogram(framed(spark, sf, ["D_V", "D_RHO"]).where(F.col("disp_id") % 3 == w), ["D_V", "D_RHO"]) for w in range(3)]
    return st.merged(parts)


@query("agg_5", f"{FRAMED}, {o.hist(['D_V'])} SELECT channel, ell_bin, theta_bin, phi_bin, sf_bin, 2 * count AS count FROM hist")
def agg_5(spark, sf):
    """Two equal slices in one table, summed over slices in one job."""
    n = fx.plane_size(spark, sf)
    ids = spark.createDataFrame([("a",), ("b",)], "slice_id string")
    rows = framed_samples(fx.grid(spark, sf).crossJoin(ids), fx.samples(spark, sf).crossJoin(ids), n, n, 3, 2, ["D_V"], extra=("slice_id",))
    return st.merged([ch.magnitude_histogram(rows, ["D_V"], extra=("slice_id",))], extra=("slice_id",))


@query("agg_5_incremental", f"{FRAMED}, {o.hist(['D_V'])} SELECT channel, ell_bin, theta_bin, phi_bin, sf_bin, count FROM hist")
def agg_5_incremental(spark, sf):
    """Histograms of the displacements, a slice each, added up as they arrive, a file a batch; half of them are delivered again by another query."""
    rows = framed(spark, sf, ["D_V"]).withColumn("slice_id", F.concat(F.lit("slice-"), F.col("disp_id").cast("string")))
    each = ch.magnitude_histogram(rows, ["D_V"], extra=("slice_id",))
    folder = work(spark, "arrivals")
    each.repartition("slice_id").write.partitionBy("slice_id").parquet(f"{folder}/first")
    again = spark.read.parquet(f"{folder}/first").where(F.substring("slice_id", 7, 9).cast("int") % 2 == 0)
    again.write.partitionBy("slice_id").parquet(f"{folder}/again")
    for name, files in (("first", 3), ("again", 1)):
        stream = spark.readStream.schema(each.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}")
        accumulate(stream, f"{folder}/totals", f"{folder}/log-{name}").trigger(availableNow=True).start().awaitTermination()
    return totals(spark, f"{folder}/totals")


def marginals_sql(bins: list[str], sets: list[tuple[str, ...]]) -> str:
    parts = [f"SELECT '{','.join(s)}' AS over, channel, {', '.join(c if c in s else f'-1 AS {c}' for c in bins)}, CAST(sum(count) AS BIGINT) AS count FROM hist GROUP BY {', '.join(['channel', *s])}" for s in sets]
    return " UNION ALL ".join(parts)


@query("agg_marginals", f"{H} {marginals_sql(['ell_bin', 'theta_bin', 'phi_bin', 'sf_bin'], st.MARGINALS)}")
def agg_marginals(spark, sf):
    """Counts by scale, by scale and angles, by scale and value, and in all, for every magnitude channel from one histogram."""
    return st.marginals(hist(spark, sf, list(ch.MAGNITUDES)))


@query("agg_6", f"{H} SELECT channel, ell_bin, CAST(sum(count) AS BIGINT) AS count FROM hist GROUP BY ALL")
def agg_6(spark, sf):
    return st.marginal(hist(spark, sf), "ell_bin")


@query("agg_7", f"{PR} SELECT channel, ell_bin, CAST(sum(count) AS BIGINT) AS count FROM prod GROUP BY ALL")
def agg_7(spark, sf):
    return st.marginal(prod(spark, sf), "ell_bin")


#: the middle of the scale bins that the default displacements are in
POPULATED = sorted({int(bisect.bisect_right(fx.ELL, math.hypot(di, dj))) - 1 for di, dj in fx.DISPLACEMENTS if fx.ELL[0] <= math.hypot(di, dj) < fx.ELL[-1]})
MIDDLE = POPULATED[len(POPULATED) // 2]


@query("agg_8", f"{FRAMED}, {o.hist(['D_V', 'D_B'])} SELECT channel, theta_bin, phi_bin, CAST(sum(count) AS BIGINT) AS count FROM hist WHERE ell_bin = {MIDDLE} GROUP BY ALL")
def agg_8(spark, sf):
    return st.at_scale(hist(spark, sf, ["D_V", "D_B"]), MIDDLE, "theta_bin", "phi_bin")


@query("agg_9", f"{FRAMED}, {o.hist(['D_V', 'D_B'])} SELECT channel, sf_bin, CAST(sum(count) AS BIGINT) AS count FROM hist WHERE ell_bin = {MIDDLE} GROUP BY ALL")
def agg_9(spark, sf):
    return st.at_scale(hist(spark, sf, ["D_V", "D_B"]), MIDDLE, "sf_bin")


def curve_sql(names: list[str], order: int = 2) -> str:
    c, e = o.edges_list(binning.centres(binning.value_edges())), o.edges_list(binning.centres(EDGES_DEFAULT))
    power = " * ".join(["c"] * order)
    root = "sqrt(m)" if order == 2 else f"pow(m, {o.num(1 / order)})"
    return f"""{FRAMED}, {o.hist(names)}, got AS (SELECT channel, ell_bin, sum(count * ({power})) / sum(count) AS m, CAST(sum(count) AS BIGINT) AS count FROM (SELECT *, ({c})[sf_bin + 1] AS c FROM hist) GROUP BY ALL),
 curve AS (SELECT x.channel, CAST(x.ell_bin AS INTEGER) AS ell_bin, ({e})[x.ell_bin + 1] AS ell_center, coalesce({root}, 0e0) AS sf_p, coalesce(count, 0) AS count
 FROM (SELECT channel, unnest(range({len(EDGES_DEFAULT) - 1})) AS ell_bin FROM (SELECT DISTINCT channel FROM hist)) x LEFT JOIN got ON got.channel = x.channel AND got.ell_bin = x.ell_bin)"""


def curves(spark, sf, names, order=2):
    return st.moments(hist(spark, sf, names), EDGES_DEFAULT, binning.value_edges(), order)


CURVES = ["D_V", "D_B", "D_RHO", "D_ZPLUS", "D_ZMINUS"]
for _p in (1, 2, 3):
    query(f"agg_10_order{_p}", f"{curve_sql(CURVES, _p)} SELECT channel, ell_bin, ell_center, round(sf_p, 9) AS sf_p, count FROM curve")(lambda spark, sf, p=_p: rounded(curves(spark, sf, CURVES, p)))


@query("agg_11", f"{curve_sql(['D_V', 'D_B'])} SELECT ell_bin, channel, ell_center, round(sf_p, 9) AS sf_p, count FROM curve WHERE ell_bin IN (SELECT ell_bin FROM curve WHERE channel = 'D_V' AND count > 0)")
def agg_11(spark, sf):
    return rounded(st.counted_scales(curves(spark, sf, ["D_V", "D_B"])))


@query("agg_12", f"{FRAMED}, {o.hist(['D_V', 'D_B'])}, cat AS (SELECT unnest(['D_V', 'D_B', 'D_J']) AS channel) SELECT cat.channel, CAST(coalesce(t, 0) AS BIGINT) AS total, CAST((SELECT sum(count) FROM hist) AS BIGINT) AS grand_total, coalesce(t, 0) = 0 AS empty FROM cat LEFT JOIN (SELECT channel, sum(count) AS t FROM hist GROUP BY channel) h ON h.channel = cat.channel")
def agg_12(spark, sf):
    return st.channel_totals(hist(spark, sf, ["D_V", "D_B"]), ["D_V", "D_B", "D_J"])


@query("agg_13", f"{H} SELECT round(count(DISTINCT theta_bin * 18 + phi_bin) / 324e0 * 100, 9) AS coverage FROM hist")
def agg_13(spark, sf):
    return rounded(st.angular_coverage(hist(spark, sf)))


@query("agg_13_literal", f"{H} SELECT round(count(DISTINCT ell_bin * 18 + theta_bin) / 324e0 * 100, 9) AS coverage FROM hist")
def agg_13_literal(spark, sf):
    return rounded(st.scale_coverage(hist(spark, sf)))


@query("agg_14", f"{RAWS} SELECT disp_id, r, dv, db, drho FROM rawinc")
def agg_14(spark, sf):
    return raw(spark, sf)


@query("agg_15", f"{RAWS} " + " UNION ALL ".join(f"SELECT '{c}' AS field, min({c}) AS least, max({c}) AS most, count(*) AS n FROM rawinc" for c in ("dv", "db", "drho")))
def agg_15(spark, sf):
    return st.raw_ranges(raw(spark, sf))


@query("agg_16", f"{RAWS} SELECT r_bin, count(*) AS n, round(avg(dv), 9) AS dv, round(avg(db), 9) AS db, round(avg(drho), 9) AS drho FROM (SELECT *, {o.bin_of('r', PLOT_EDGES)} AS r_bin FROM rawinc) WHERE r_bin >= 0 GROUP BY r_bin")
def agg_16(spark, sf):
    rows = raw(spark, sf)
    return rounded(st.binned_means(rows, st.plot_scales(rows)))


@query("agg_17", f"{P}, m AS (SELECT rho, {o.length('v')} AS v, {o.length('b')} AS b FROM plane) " + " UNION ALL ".join(f"SELECT '{c}' AS field, min({c}) AS least, max({c}) AS most, round(avg({c}), 9) AS mean FROM m" for c in ("rho", "v", "b")))
def agg_17(spark, sf):
    return st.field_statistics(fx.plane(spark, sf)).withColumn("mean", F.round("mean", 9))


@query("agg_18", f"{BAD}, b2 AS (SELECT *, CAST('NaN' AS DOUBLE) AS omega_x FROM bad) " + " UNION ALL ".join(f"SELECT '{c}' AS field, min({c}) FILTER (NOT isnan({c})) AS least, max({c}) FILTER (NOT isnan({c})) AS most, count_if(NOT isnan({c})) = 0 AS all_nan FROM b2" for c in ("v_x", "b_x", "omega_x")))
def agg_18(spark, sf):
    return st.ranges_without_nan(sl.filled(bad_plane(spark, sf)), ["v_x", "b_x", "omega_x"])


@query("agg_19", f"{S} SELECT count(DISTINCT disp_id) AS displacements, count(*) AS evaluations FROM samp")
def agg_19(spark, sf):
    return st.evaluations(fx.samples(spark, sf))


# ---- curves ------------------------------------------------------------------------------------


@query("post_1", f"""{curve_sql(CURVES)}, pts AS (SELECT channel, ell_bin, log10(ell_center) AS x, log10(sf_p) AS y FROM curve WHERE sf_p > 0),
 w AS (SELECT channel, ell_bin, regr_slope(y, x) OVER f AS slope, count(*) OVER f AS n, lead(x, 1) OVER q AS x1, lead(x, 2) OVER q AS x2 FROM pts WINDOW q AS (PARTITION BY channel ORDER BY ell_bin), f AS (PARTITION BY channel ORDER BY ell_bin ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
 SELECT channel, ell_bin, round(pow(10e0, (x1 + x2) / 2), 7) AS ell_mid, round(slope, 7) AS slope FROM w WHERE n = 4""")
def post_1(spark, sf):
    return rounded(st.local_slopes(curves(spark, sf, CURVES)), 7)


@query("post_2", f"""{curve_sql(['D_V', 'D_B'])}, q AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ell_bin) - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM curve WHERE count > 0),
 m AS (SELECT channel, sf_p / pow(ell_center, {o.num(1 / 3)}) AS c FROM q WHERE k = n // 2) SELECT q.channel, ell_bin, round(c * pow(ell_center, {o.num(1 / 3)}), 9) AS reference FROM q JOIN m ON m.channel = q.channel""")
def post_2(spark, sf):
    return rounded(st.reference_curve(curves(spark, sf, ["D_V", "D_B"]), 1 / 3))


@query("post_3", f"{curve_sql(['D_ZPLUS', 'D_ZMINUS'])} SELECT a.ell_bin, round(a.sf_p / nullif(b.sf_p, 0), 9) AS ratio FROM curve a JOIN curve b ON a.ell_bin = b.ell_bin AND a.channel = 'D_ZPLUS' AND b.channel = 'D_ZMINUS'")
def post_3(spark, sf):
    return rounded(st.asymmetry(curves(spark, sf, ["D_ZPLUS", "D_ZMINUS"])))


PAIR = ["D_V_CROSS_B", "D_V_D_B_MAG"]


@query("post_4", f"{FRAMED}, {o.prod(PAIR)} SELECT coalesce(a.ell_bin, b.ell_bin) AS ell_bin, coalesce(a.product_bin, b.product_bin) AS product_bin, round(asin(least(coalesce(a.count, 0) / (coalesce(b.count, 0) + 1e-10), 1e0)), 9) AS angle FROM (SELECT * FROM prod WHERE channel = '{PAIR[0]}') a FULL JOIN (SELECT * FROM prod WHERE channel = '{PAIR[1]}') b ON a.ell_bin = b.ell_bin AND a.product_bin = b.product_bin")
def post_4(spark, sf):
    return rounded(st.count_angles(prod(spark, sf, PAIR), *PAIR))


@query("post_5", f"{curve_sql(['D_V'])} SELECT channel, ell_bin, ell_center, round(sf_p, 9) AS sf_p, count, unnest(['first', 'second']) AS label FROM curve")
def post_5(spark, sf):
    return rounded(st.compared({"first": curves(spark, sf, ["D_V"]), "second": curves(spark, sf, ["D_V"])}))


# ---- composites --------------------------------------------------------------------------------

BOTH = f"{FRAMED}, {o.hist(list(ch.MAGNITUDES))}, {o.prod(list(ch.PRODUCTS))} SELECT channel, ell_bin, theta_bin, phi_bin, sf_bin AS value_bin, count FROM hist UNION ALL SELECT channel, ell_bin, -1 AS theta_bin, -1 AS phi_bin, product_bin AS value_bin, count FROM prod"


@query("api_1", BOTH)
def api_1(spark, sf):
    """All 28 channels in one pass over the samples."""
    return ch.all_histograms(framed(spark, sf))


for _axis in (1, 2):
    _sql = f"{o.BASE}, {o.frames(2, _axis)}, {o.hist(['D_V', 'D_B'])} SELECT * FROM hist"
    query(f"api_3_axis{_axis}", _sql)(lambda spark, sf, a=_axis: ch.magnitude_histogram(framed(spark, sf, ["D_V", "D_B"], a), ["D_V", "D_B"]))
for _w in (3, 5):
    _sql = f"{o.BASE}, {o.frames(_w)}, {o.hist(['D_V', 'D_B'])} SELECT * FROM hist"
    query(f"api_3_width{_w}", _sql)(lambda spark, sf, w=_w: ch.magnitude_histogram(framed(spark, sf, ["D_V", "D_B"], 3, w), ["D_V", "D_B"]))


CATALOGUE = "(VALUES " + ", ".join(f"('{c}')" for c in ch.MAGNITUDES) + ") AS t(channel)"


@query("api_1_random", f"SELECT channel, true AS counted, true AS within, true AS distinct_bins FROM {CATALOGUE}")
def api_1_random(spark, sf):
    """The whole analysis with displacements of its own draw: for each channel, what holds whatever is drawn."""
    found = analyse_slice(fx.grid(spark, sf), n_displacements=200, n_ell_bins=8, n_random_subsamples=200, axis=3, seed=3)
    most = found.displacements.count() * 200
    bins = [F.col("ell_bin").between(0, 7), F.col("theta_bin").between(0, 17), F.col("phi_bin").between(0, 17), F.col("sf_bin").between(0, 126), F.col("count") > 0]
    within = F.min(bins[0] & bins[1] & bins[2] & bins[3] & bins[4])
    return found.magnitudes.groupBy("channel").agg((F.sum("count") <= most).alias("counted"), within.alias("within"), (F.count("*") == F.countDistinct("ell_bin", "theta_bin", "phi_bin", "sf_bin")).alias("distinct_bins"))


def batch(spark: SparkSession, sf: str) -> str:
    """The folder of a batch run over the plane's list, with the default displacements."""
    run = cf.RunConfig(slice_list=stored_slices(spark, sf), n_random_subsamples=fx.SAMPLES, n_ell_bins=fx.SCALE_BINS)
    return jobs.run_batch(spark, run, out=work(spark, "result"), displacements=fx.displacements(spark), ell=fx.ELL)


@query("api_4", BOTH)
def api_4(spark, sf):
    """Counts as a batch run stored them: list file to slices to result."""
    return cf.read_result(spark, batch(spark, sf), "counts")


META = {"n_slices": 1, "stride": 1, "stencil_width": 2, "N_random_subsamples": fx.SAMPLES, "axis": 3, "beta": 25.0}


@query("snk_2", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in META.items()) + ") AS t(name, value)")
def snk_2(spark, sf):
    """Metadata of a stored batch result."""
    return cf.read_result(spark, batch(spark, sf), "run_meta").select(F.explode("meta").alias("name", "value"))


@query("phy_3_observed", f"{G} SELECT unnest(['n_cells', 'n_bad_density', 'rho_min', 'n_nan', 'n_inf']) AS name, unnest([count(*)::DOUBLE, count_if(rho <= 0)::DOUBLE, min(rho), 0e0, 0e0]) AS value FROM grid")
def phy_3_observed(spark, sf):
    """Quality of a batch run's cells, observed while its counts were written."""
    return cf.read_result(spark, batch(spark, sf), "quality")


@query("snk_4", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{f}', {k})" for k, (c, f) in enumerate([*((c, "magnitude") for c in ch.MAGNITUDES), *((c, "product") for c in ch.PRODUCTS)])) + ") AS t(name, family, idx)")
def snk_4(spark, sf):
    """The catalogue of channels in a stored result."""
    return cf.read_result(spark, batch(spark, sf), "channels")


@query("snk_6", f"{FRAMED}, {o.hist(list(ch.MAGNITUDES))} SELECT channel, ell_bin, CAST(sum(count) AS BIGINT) AS count FROM hist GROUP BY channel, ell_bin")
def snk_6(spark, sf):
    """Mean curves in a stored result: counts of the scale bins that have any."""
    return cf.read_result(spark, batch(spark, sf), "curves").where("count > 0").select("channel", "ell_bin", "count")


def simple(spark: SparkSession, sf: str) -> str:
    """The folder of a simple run over the plane's list."""
    run, out = cf.RunConfig(slice_list=stored_slices(spark, sf), n_random_subsamples=fx.SAMPLES), work(spark, "simple")
    if failed := jobs.run_simple(spark, run, out, displacements=fx.displacements(spark)):
        raise RuntimeError(str(failed))
    return out


@query("api_5", sql_rounded(f"{RAWS} SELECT disp_id, r, dv, db, drho FROM rawinc", ["r", "dv", "db", "drho"]))
def api_5(spark, sf):
    """Raw increments as a simple run stored them."""
    return rounded(jobs.read_simple(spark, simple(spark, sf)))


@query("src_13", sql_rounded(f"{RAWS} SELECT disp_id, count(*) AS n, min(dv) AS least, max(dv) AS most FROM rawinc GROUP BY disp_id", ["least", "most"]))
def src_13(spark, sf):
    """A stored simple result read back by name."""
    raw = jobs.read_simple(spark, simple(spark, sf), "slice_x3_0_beta25")
    return rounded(raw.groupBy("disp_id").agg(F.count("*").alias("n"), F.min("dv").alias("least"), F.max("dv").alias("most")))


@query("api_6", f"{RAWS} SELECT r_bin, count(*) AS n, round(avg(dv), 9) AS dv, round(avg(db), 9) AS db, round(avg(drho), 9) AS drho FROM (SELECT *, {o.bin_of('r', PLOT_EDGES)} AS r_bin FROM rawinc) WHERE r_bin >= 0 GROUP BY r_bin")
def api_6(spark, sf):
    """Curves of the first stored simple result."""
    return rounded(jobs.simple_curves(spark, simple(spark, sf)))


def pipeline_sql() -> str:
    """Counts of the three middle slices, of every second cell, by axis, channel, scale and value bin."""
    parts = []
    names = ", ".join(f"{k} AS {v}" for k, v in sl.FIELDS.items())
    va = ", ".join(f"CASE WHEN rho > 0 AND NOT isnan(rho) THEN b_{c} * (1e0 / sqrt(greatest(rho, 1e-10))) ELSE 0e0 END AS va_{c}" for c in "xyz")
    z = ", ".join(f"v_{c} {sign} va_{c} AS {name}_{c}" for name, sign in (("zp", "+"), ("zm", "-")) for c in "xyz")
    for axis in (1, 2, 3):
        ctes = [
            f"sliced AS ({slice_sql(axis, 'a.n // 2 - 1')})",
            f"nn AS (SELECT (n + 1) // 2 AS n FROM (WITH {VN} SELECT n FROM vn))",
            f"alf AS (SELECT *, {va} FROM (SELECT j // 2 AS j, i // 2 AS i, {names} FROM sliced WHERE j % 2 = 0 AND i % 2 = 0))",
            f"grid AS (SELECT *, {z} FROM alf)",
            o.DISP, o.SCALED, o.permuted(f"least({jobs.PIPELINE['n_random_subsamples']}, n * n)"), o.frames(2, axis), o.hist(list(ch.MAGNITUDES)), o.prod(list(ch.PRODUCTS)),
        ]
        body = "SELECT channel, ell_bin, sf_bin AS value_bin, count FROM hist UNION ALL SELECT channel, ell_bin, product_bin AS value_bin, count FROM prod"
        parts.append(f"SELECT {axis} AS axis, channel, ell_bin, value_bin, CAST(sum(count) AS BIGINT) AS count FROM ({o.with_(*ctes)} {body}) GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query("api_7", pipeline_sql())
def api_7(spark, sf):
    """Three slices of the volume, extracted, analysed and stored: counts by axis, channel, scale and value bin."""
    n = fx.volume_size(spark, sf)
    return jobs.run_pipeline(spark, fx.volume(spark, sf), n, work(spark, "pipeline"), displacements=fx.displacements(spark), ell=fx.ELL)


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
