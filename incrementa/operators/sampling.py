"""Sample positions and periodic stencils (SMP-1..3, STN-1..9)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incrementa.functions.binning import bin_index
from incrementa.functions.vectors import Vec

#: offsets of each stencil, in displacements, with the weights of its increment
STENCILS = {2: {0: -1, 1: 1}, 3: {-1: 1, 0: -2, 1: 1}, 5: {-2: -1, -1: 16, 0: -30, 1: 16, 2: -1}}
#: bytes of a slice up to which it is broadcast
BROADCAST_BYTES = 128 << 20
#: order in which the terms of an increment, and of the mean field, are added
ORDER = {2: (1, 0), 3: (1, 0, -1), 5: (2, 1, 0, -1, -2)}


def stencil(width: int) -> dict[int, int]:
    if width not in STENCILS:
        raise ValueError("stencil width must be 2, 3 or 5")
    return STENCILS[width]


def _coprime(size: int, like: int) -> int:
    a = like % size or 1
    while math.gcd(a, size) != 1:
        a += 1
    return a


def affine_samples(disp: DataFrame, rows: int, columns: int, n: int, step: int = 7919, shift: int = 104729) -> DataFrame:
    """(disp columns, k, j, i): ``n`` distinct positions for each displacement by an affine permutation; no sort, no state."""
    size = rows * columns
    if n > size:
        raise ValueError("more samples than cells")
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    out = disp.select("*", k)
    pos = (F.col("k") * F.lit(_coprime(size, step)).cast("long") + F.col("disp_id") * F.lit(shift).cast("long")) % F.lit(size)
    return positions(out.withColumn("pos", pos), columns).drop("pos")


#: fixed values: a prime, and the numbers that keys and rounds are mixed with
PRIME, MIX, ROUNDS, SAMPLE_BLOCK = 2147483647, (48271, 16807, 69621, 40692), 4, 4096
#: samples of a displacement for each task
TASK_SAMPLES = 16 * SAMPLE_BLOCK


def sample_tasks(spark: SparkSession, n: int) -> int:
    """Tasks over ``n`` samples of each displacement: a task's share does not grow with ``n``, whatever the session's number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_SAMPLES))


def stirred(x: Column, key: Column) -> Column:
    """A number under PRIME that depends on x and key in a way hard to tell from chance; all products stay under 2 ^ 62."""
    y = (x * MIX[0] + key) % PRIME
    return (y * ((y * y + MIX[1]) % PRIME)) % PRIME


def permuted_samples(disp: DataFrame, rows: int, columns: int, n: int, seed: int = 0) -> DataFrame:
    """(disp columns, k, j, i): ``n`` distinct positions for each displacement, independent for each and given by ``seed``.

    Sample k is the k-th place of a permutation of all cells keyed by seed and displacement: rounds that shift the
    row by a number stirred from the column, then the column by one from the row. No sort, no state, no shuffle.
    """
    if n > rows * columns:
        raise ValueError("more samples than cells")
    whole = F.col("disp_id").cast("long")
    key = (stirred(whole * MIX[2] % PRIME, F.lit(seed % PRIME).cast("long")) * MIX[3] + whole) % PRIME
    blocks = disp.select("*", key.alias("__key"), F.explode(F.sequence(F.lit(0), F.lit((n - 1) // SAMPLE_BLOCK))).alias("__block"))
    # the list comes in one partition; its rows are few, what is made of them is not
    blocks = blocks.repartition(sample_tasks(disp.sparkSession, n), "disp_id", "__block")
    ks = F.sequence(F.col("__block") * SAMPLE_BLOCK, F.least(F.col("__block") * SAMPLE_BLOCK + (SAMPLE_BLOCK - 1), F.lit(n - 1)))
    at = blocks.select(*disp.columns, "__key", F.explode(ks).alias("k")).withColumn("__k", F.col("k").cast("long"))
    at = at.select(*disp.columns, "k", "__key", F.floor(F.col("__k") / F.lit(columns)).alias("j"), (F.col("__k") % columns).alias("i"))
    # a column a step, so that each is computed once, in generated code
    for t in range(ROUNDS):
        for moved, by, size in (("j", "i", rows), ("i", "j", columns)):
            y = (F.col(by) * MIX[0] + (F.col("__key") + t * 1000003) % PRIME) % PRIME
            at = at.withColumn("__y", y).withColumn("__z", (F.col("__y") * F.col("__y") + MIX[1]) % PRIME)
            at = at.withColumn(moved, (F.col(moved) + F.col("__y") * F.col("__z") % PRIME) % size)
    # the row number keeps filters on the places above these steps, which they would run through twice
    at = at.select(*disp.columns, "k", F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), F.monotonically_increasing_id().alias("__row"))
    return at.where("__row >= 0").drop("__row")


def every_position(disp: DataFrame, grid: DataFrame) -> DataFrame:
    """(disp columns, j, i): all cells for each displacement."""
    return grid.select("j", "i").crossJoin(F.broadcast(disp))  # a displacement list is bounded by its request


def positions(flat: DataFrame, columns: int) -> DataFrame:
    """Adds j, i of the flat position ``pos``."""
    return flat.withColumns({"j": F.floor(F.col("pos") / F.lit(columns)).cast("int"), "i": (F.col("pos") % F.lit(columns)).cast("int")})


def with_scale(disp: DataFrame, edges: list[float]) -> DataFrame:
    """Adds r and ell_bin; displacements outside all scale bins go before anything is sampled."""
    r = F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double"))
    out = disp.withColumn("r", r)
    return out.withColumn("ell_bin", bin_index(F.col("r"), edges)).where("ell_bin >= 0")


def displacement_vector(axis: int) -> Vec:
    """The displacement in space for a slice normal to ``axis``."""
    di, dj, none = F.col("di").cast("double"), F.col("dj").cast("double"), F.lit(0.0)
    return {1: Vec(none, di, dj), 2: Vec(di, none, dj)}.get(axis, Vec(di, dj, none))


def relation_bytes(cells: int, fields: int) -> int:
    """Most bytes of a broadcast relation of so many cells: rows of fixed width with their two keys and a link, and the table of their places, each grown by doubling."""
    doubled = lambda n: 1 << max(n - 1, 1).bit_length()
    return max(1 << 20, doubled(cells * 8 * (fields + 4))) + 16 * doubled(2 * cells)


def gather(samples: DataFrame, grid: DataFrame, fields: list[str], rows: int, columns: int, width: int = 2) -> DataFrame:
    """``samples`` with ``field__k`` for each field and stencil offset k, by equi-joins on wrapped coordinates.

    A single slice whose relation takes at most ``BROADCAST_BYTES``, known from its shape, is broadcast once for all
    offsets and read by a lookup each. Anything larger is joined once, whatever the width: see :func:`gather_points`.
    """
    by_slice = ["slice_id"] if "slice_id" in samples.columns and "slice_id" in grid.columns else []
    if by_slice or relation_bytes(rows * columns, len(fields)) > BROADCAST_BYTES:
        return gather_points(samples, grid, fields, rows, columns, width)
    every = grid.select(F.col("j").alias("__j"), F.col("i").alias("__i"), *fields)
    out = samples
    for k in sorted(stencil(width)):
        met = at_offset(out, F.lit(k), rows, columns).join(F.broadcast(every), ["__j", "__i"]).drop("__j", "__i")
        out = met.withColumnsRenamed({f: f"{f}__{k}" for f in fields})
    return out


def at_offset(samples: DataFrame, k: Column, rows: int, columns: int) -> DataFrame:
    """``samples`` with the wrapped place __j, __i of the stencil's point ``k``."""
    return samples.withColumns({"__j": F.pmod(F.col("j") + k * F.col("dj"), F.lit(rows)), "__i": F.pmod(F.col("i") + k * F.col("di"), F.lit(columns))})


def gather_points(samples: DataFrame, grid: DataFrame, fields: list[str], rows: int, columns: int, width: int = 2) -> DataFrame:
    """As :func:`gather`, with one join of the grid: samples go out as a row a point and come back together by sample.

    The samples and the grid are shuffled once each to meet, and what was read once more to be put beside each other,
    at any width; a join a point would shuffle ever wider samples once a point.
    """
    by_slice = ["slice_id"] if "slice_id" in samples.columns and "slice_id" in grid.columns else []
    keys = [*by_slice, "disp_id", *(["k"] if "k" in samples.columns else []), "j", "i"]
    rest = [c for c in samples.columns if c not in keys]
    every = grid.select(*by_slice, F.col("j").alias("__j"), F.col("i").alias("__i"), *fields)
    points = at_offset(samples.withColumn("__k", F.explode(F.array(*map(F.lit, sorted(stencil(width)))))), F.col("__k"), rows, columns)
    met = points.join(every, [*by_slice, "__j", "__i"])
    pick = [F.max(F.when(F.col("__k") == k, F.col(f))).alias(f"{f}__{k}") for k in sorted(stencil(width)) for f in fields]
    back = met.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest), F.count("*").alias("__n"), *pick)
    return back.where(F.col("__n") == len(stencil(width))).select(*samples.columns, *(f"{f}__{k}" for k in sorted(stencil(width)) for f in fields))


def increment(field: str, width: int = 2) -> Column:
    """The stencil's un-normalised difference of a gathered field."""
    weights = stencil(width)
    if width == 2:
        return F.col(f"{field}__1") - F.col(f"{field}__0")
    if width == 3:
        return F.col(f"{field}__1") - 2.0 * F.col(f"{field}__0") + F.col(f"{field}__-1")
    terms = [F.lit(float(weights[k])) * F.col(f"{field}__{k}") for k in ORDER[5]]
    return sum(terms[1:], terms[0])


def stencil_mean(field: str, width: int = 2) -> Column:
    """Plain average over the stencil's points."""
    terms = [F.col(f"{field}__{k}") for k in ORDER[width]]
    return sum(terms[1:], terms[0]) / F.lit(float(width))
