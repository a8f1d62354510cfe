"""Volume to slice: plane selection, neighbour planes, derived fields (VOL-5..16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.functions.morton import block_bounds, decode, slice_index
from incrementa.functions.vectors import Vec

PRIMITIVES = ["dens", "velx", "vely", "velz", "bcc1", "bcc2", "bcc3"]
#: fixed values: by slice axis, the volume's coordinates that are the plane's normal, rows and columns
LAYOUT = {1: ("i", "k", "j"), 2: ("j", "k", "i"), 3: ("k", "j", "i")}
#: fixed values: which space direction (0 x, 1 y, 2 z) the plane's normal, rows and columns are
DIRECTIONS = {1: (0, 2, 1), 2: (1, 2, 0), 3: (2, 1, 0)}
UNIT_FLOOR = 1e-10
#: cells along an edge of the tiles that a plane is dealt to; ghosts add 4 / TILE to what is sent
TILE = 64


def check_axis(axis: int) -> None:
    if axis not in LAYOUT:
        raise ValueError("axis must be 1, 2 or 3")


def layout(gids: DataFrame, size: int, n: int) -> DataFrame:
    """(gid, at_1.., lo_1.., hi_1..): place and extent of each meshblock of ``size`` cells, from its Morton code; at most 2 ** 18 rows."""
    third, second, first = decode(F.col("gid"))
    out = gids.select("gid", first.alias("at_1"), second.alias("at_2"), third.alias("at_3"))
    for c in (1, 2, 3):
        lo, hi = block_bounds(F.col(f"at_{c}"), size, n)
        out = out.withColumns({f"lo_{c}": lo, f"hi_{c}": hi})
    return out


def blocks_of(blocks: DataFrame, axis: int, value: float) -> DataFrame:
    """Meshblocks (lo_1.., hi_1..) whose closed extent along the axis holds ``value``."""
    check_axis(axis)
    return blocks.where((F.col(f"lo_{axis}") <= value) & (F.col(f"hi_{axis}") >= value))


def blocks_about(blocks: DataFrame, axis: int, index: int, size: int, n: int) -> DataFrame:
    """(gid) of the meshblocks that hold plane ``index`` or one of the periodic planes before and after it."""
    check_axis(axis)
    return blocks.where(F.col(f"at_{axis}").isin(sorted({(index + d) % n // size for d in (-1, 0, 1)}))).select("gid")


def store_volume(volume: DataFrame, path: str, size: int, n: int) -> None:
    """Write a volume (gid, k, j, i, fields) a folder for each meshblock, and the layout beside it: what a slice needs is found without a scan."""
    cells = volume.select(*(F.col(c).cast("int").alias(c) for c in ("gid", "k", "j", "i")), *(F.col(f).cast("double").alias(f) for f in PRIMITIVES))
    cells.repartition("gid").write.mode("overwrite").partitionBy("gid").parquet(f"{path}/cells")
    layout(stored_cells(volume.sparkSession, path).select("gid").distinct(), size, n).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def stored_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of a stored volume; no file is opened to find out what is in it."""
    return spark.read.schema("k int, j int, i int, " + "".join(f"{f} double, " for f in PRIMITIVES) + "gid int").parquet(f"{path}/cells")


def stored_planes(spark: SparkSession, path: str, axis: int, index: int, size: int, n: int) -> DataFrame:
    """The cells of the meshblocks about a plane: the layout's gids reach the scan as a dynamic partition filter, so no other block is read."""
    wanted = blocks_about(spark.read.parquet(f"{path}/layout"), axis, index, size, n)
    return stored_cells(spark, path).join(F.broadcast(wanted), "gid", "left_semi")  # under 2 ** 18 rows by the code's width


def plane(volume: DataFrame, axis: int, index: int, fields: list[str] = PRIMITIVES) -> DataFrame:
    """(j, i, fields): one plane; the filter on the normal coordinate reaches the scan."""
    check_axis(axis)
    normal, row, col = LAYOUT[axis]
    return volume.where(F.col(normal) == index).select(F.col(row).alias("j"), F.col(col).alias("i"), *fields)


def with_neighbour_planes(volume: DataFrame, axis: int, index: int, n: int, fields: list[str] = PRIMITIVES) -> DataFrame:
    """The plane with ``field_p`` and ``field_m`` of the periodic planes after and before it, in one scan and one shuffle."""
    check_axis(axis)
    normal, row, col = LAYOUT[axis]
    tags = {"": index % n, "_p": (index + 1) % n, "_m": (index - 1) % n}
    three = volume.where(F.col(normal).isin(sorted(set(tags.values()))))
    pick = [F.max(F.when(F.col(normal) == at, F.col(f))).alias(f"{f}{tag}") for tag, at in tags.items() for f in fields]
    return three.groupBy(F.col(row).alias("j"), F.col(col).alias("i")).agg(*pick)


def unit_fields(df: DataFrame) -> DataFrame:
    """Adds unit1..3 = B / sqrt(B^2 + floor) for the plane and its neighbours."""
    out = {}
    for tag in ("", "_p", "_m"):
        b = [F.col(f"bcc{c}{tag}") for c in (1, 2, 3)]
        size = F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2] + F.lit(UNIT_FLOOR))
        out |= {f"unit{c}{tag}": v / size for c, v in zip((1, 2, 3), b)}
    return df.withColumns(out)


def in_tiles(df: DataFrame, n: int, ghosts: Column | None = None) -> DataFrame:
    """``df`` (j, i) of an n x n plane dealt to tiles: adds the tile (tj, ti) and the place in it (lj, li).

    A cell at a tile's border goes to the tile beyond it as well, periodically, where its place is -1 or one past the
    last: the ghost rows that a stencil needs. ``ghosts`` tells which rows are copied so, all by default.
    """
    last = (n - 1) // TILE
    j, i, tj, ti = F.col("j"), F.col("i"), F.floor(F.col("j") / F.lit(TILE)).cast("int"), F.floor(F.col("i") / F.lit(TILE)).cast("int")
    lj, li = j - tj * TILE, i - ti * TILE
    size = lambda t: F.when(t == last, n - last * TILE).otherwise(F.lit(TILE))
    before, after = lambda t: F.pmod(t - 1, F.lit(last + 1)), lambda t: F.pmod(t + 1, F.lit(last + 1))
    place = lambda a, b, c, d: F.struct(a.cast("int").alias("tj"), b.cast("int").alias("ti"), c.cast("int").alias("lj"), d.cast("int").alias("li"))
    told = F.lit(True) if ghosts is None else ghosts
    copies = [
        F.when(told & (lj == 0), place(before(tj), ti, size(before(tj)), li)),
        F.when(told & (lj == size(tj) - 1), place(after(tj), ti, F.lit(-1), li)),
        F.when(told & (li == 0), place(tj, before(ti), lj, size(before(ti)))),
        F.when(told & (li == size(ti) - 1), place(tj, after(ti), lj, F.lit(-1))),
    ]
    return df.select("*", F.explode(F.array_compact(F.array(place(tj, ti, lj, li), *copies))).alias("__to")).select(*df.columns, "__to.*")


def beside(tiles: DataFrame, fields: list[str], n: int) -> DataFrame:
    """Adds field_jp, _jm, _ip, _im: neighbours along rows and columns within tiles that hold their ghosts; ghosts go, and cells that lack a neighbour.

    The windows need a tile's cells together and no more, so one exchange by tile serves them all.
    """
    out = tiles
    for tag, along, across in (("j", "lj", "li"), ("i", "li", "lj")):
        w = W.partitionBy("tj", "ti", across).orderBy(along)
        near = {f"{f}_{tag}{side}": move(f).over(w) for side, move in (("p", F.lead), ("m", F.lag)) for f in fields}
        out = out.withColumns(near | {f"__{tag}p": F.lead(along).over(w) - F.col(along), f"__{tag}m": F.col(along) - F.lag(along).over(w)})
    inside = lambda at, tile: F.col(at).between(0, TILE - 1) & (F.col(tile) * TILE + F.col(at) < n)
    whole = F.col("__jp").eqNullSafe(1) & F.col("__jm").eqNullSafe(1) & F.col("__ip").eqNullSafe(1) & F.col("__im").eqNullSafe(1)
    return out.where(inside("lj", "tj") & inside("li", "ti") & whole).drop("tj", "ti", "lj", "li", "__jp", "__jm", "__ip", "__im")


def with_in_plane_neighbours(df: DataFrame, fields: list[str], n: int) -> DataFrame:
    """Adds field_jp, _jm, _ip, _im: periodic neighbours along rows and columns, by one exchange of tiles with their ghost rows."""
    return beside(in_tiles(df, n).repartition("tj", "ti"), fields, n)


def central(field: str, direction: int, axis: int, n: int) -> Column:
    """Central difference along x, y or z: in the plane from neighbours, off it from the planes after and before."""
    normal, row, _ = DIRECTIONS[axis]
    hi, lo = ("_p", "_m") if direction == normal else ("_jp", "_jm") if direction == row else ("_ip", "_im")
    return (F.col(field + hi) - F.col(field + lo)) / F.lit(2.0 / n)


def curl(names: tuple[str, str, str], axis: int, n: int) -> tuple[Column, Column, Column]:
    d = lambda k, direction: central(names[k], direction, axis, n)
    return d(2, 1) - d(1, 2), d(0, 2) - d(2, 0), d(1, 0) - d(0, 1)


def curvature(axis: int, n: int) -> list[Column]:
    """(b . grad) b of the unit field."""
    out = []
    for c in (1, 2, 3):
        terms = [F.col(f"unit{k + 1}") * central(f"unit{c}", k, axis, n) for k in range(3)]
        out.append(terms[0] + terms[1] + terms[2])
    return out


def derived(df: DataFrame, axis: int, n: int) -> DataFrame:
    """(j, i, 7 primitives, vort*, curr*, curv*, grad_rho_*) of a plane with all its neighbours."""
    parts = {"vort": curl(("velx", "vely", "velz"), axis, n), "curr": curl(("bcc1", "bcc2", "bcc3"), axis, n), "curv": curvature(axis, n), "grad_rho_": [central("dens", k, axis, n) for k in range(3)]}
    return df.select("j", "i", *PRIMITIVES, *(v.alias(f"{name}{c}") for name, columns in parts.items() for c, v in zip("xyz", columns)))


def with_all_neighbours(volume: DataFrame, axis: int, index: int, n: int) -> DataFrame:
    """The plane with the planes after and before it (_p, _m), the unit fields and the neighbours in the plane, in one exchange.

    Cells of the three planes go to tiles of the plane; only those of the plane itself are also sent as ghosts. A tile's
    cells are folded to one row a place where they are, then the neighbours are read beside them.
    """
    check_axis(axis)
    normal, row, col = LAYOUT[axis]
    tags = {"": index % n, "_p": (index + 1) % n, "_m": (index - 1) % n}
    three = volume.where(F.col(normal).isin(sorted(set(tags.values())))).select(F.col(normal).alias("__at"), F.col(row).alias("j"), F.col(col).alias("i"), *PRIMITIVES)
    tiles = in_tiles(three, n, F.col("__at") == tags[""]).repartition("tj", "ti")
    pick = [F.max(F.when(F.col("__at") == at, F.col(f))).alias(f"{f}{tag}") for tag, at in tags.items() for f in PRIMITIVES]
    folded = unit_fields(tiles.groupBy("tj", "ti", "lj", "li", "j", "i").agg(*pick))
    return beside(folded, [*PRIMITIVES, "unit1", "unit2", "unit3"], n)


def extract_slice(volume: DataFrame, axis: int, value: float, n: int) -> DataFrame:
    """The slice at ``value`` along ``axis`` with its 19 fields, as one lazy plan."""
    check_axis(axis)
    return derived(with_all_neighbours(volume, axis, slice_index(value, n), n), axis, n)


def extract_stored(spark: SparkSession, path: str, axis: int, value: float, size: int, n: int) -> DataFrame:
    """As :func:`extract_slice` of a stored volume, of which only the meshblocks about the plane are read."""
    check_axis(axis)
    return extract_slice(stored_planes(spark, path, axis, slice_index(value, n), size, n), axis, value, n)


def planar_derivatives(df: DataFrame, n: int) -> DataFrame:
    """Adds omega_*, j_*, curv_*, grad_rho_* to a slice normal to z that has no neighbour planes; off-plane differences are 0."""
    b = Vec.of("b")
    size = F.sqrt(b.x * b.x + b.y * b.y + b.z * b.z + F.lit(UNIT_FLOOR))
    base = df.withColumns({f"n_{c}": v / size for c, v in zip("xyz", b)})
    fields = ["rho", *(f"{v}_{c}" for v in "vbn" for c in "xyz")]
    near = with_in_plane_neighbours(base, fields, n)
    ddx = lambda f: (F.col(f"{f}_ip") - F.col(f"{f}_im")) / F.lit(2.0 / n)
    ddy = lambda f: (F.col(f"{f}_jp") - F.col(f"{f}_jm")) / F.lit(2.0 / n)
    out = {"omega": (ddy("v_z"), -ddx("v_z"), ddx("v_y") - ddy("v_x")), "j": (ddy("b_z"), -ddx("b_z"), ddx("b_y") - ddy("b_x")), "curv": tuple(F.col("n_x") * ddx(f"n_{c}") + F.col("n_y") * ddy(f"n_{c}") for c in "xyz"), "grad_rho": (ddx("rho"), ddy("rho"), F.lit(0.0))}
    return near.select(*df.columns, *(v.alias(f"{name}_{c}") for name, columns in out.items() for c, v in zip("xyz", columns)))
