"""Row-wise field projections (PHY-1..6). NaN, not null, stands for a missing value throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incrementa.functions.vectors import Vec, minus, norm, plus

FLOOR = 1e-10


def alfven(df: DataFrame, least: float = FLOOR) -> DataFrame:
    """Adds va_*: B over the root of rho, 0 where rho is not positive (NaN is not); rho counts as ``least`` at least. Spark's NaN > 0 holds, hence the guard."""
    rho = F.col("rho")
    factor = F.lit(1.0) / F.sqrt(F.greatest(rho, F.lit(least)))
    good = (rho > 0) & ~F.isnan(rho)
    return df.withColumns({f"va_{c}": F.when(good, F.col(f"b_{c}") * factor).otherwise(F.lit(0.0)) for c in "xyz"})


def elsasser(df: DataFrame) -> DataFrame:
    """Adds zp_* = v + va and zm_* = v - va."""
    v, a = Vec.of("v"), Vec.of("va")
    new = {f"zp_{c}": x for c, x in zip("xyz", plus(v, a))} | {f"zm_{c}": x for c, x in zip("xyz", minus(v, a))}
    return df.withColumns(new)


def density_report(df: DataFrame) -> DataFrame:
    """(n_bad, rho_min): rows whose density is not positive."""
    rho = F.col("rho")
    return df.agg(F.count_if((rho <= 0) & ~F.isnan(rho)).alias("n_bad"), F.min(F.when(~F.isnan(rho), rho)).alias("rho_min"))


def finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_nan, n_inf) for each of ``columns``, in one pass."""
    counted = df.agg(*(x for c in columns for x in (F.count_if(F.isnan(c)).alias(f"{c}__nan"), F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))).alias(f"{c}__inf"))))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}__nan").alias("n_nan"), F.col(f"{c}__inf").alias("n_inf")) for c in columns))
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def magnitude(name: str) -> Column:
    return norm(Vec.of(name))


def quality_metrics() -> list[Column]:
    """Aggregates that tell the quality of a slice's cells while something else is made of them: see ``DataFrame.observe``."""
    vectors = [F.col(f"{v}_{c}") for v in "vb" for c in "xyz"]
    any_of = lambda test: F.sum(sum((test(c).cast("long") for c in vectors), F.lit(0).cast("long")))
    infinite = lambda c: F.abs(c) == float("inf")
    rho = F.col("rho")
    return [F.count("*").alias("n_cells"), F.count_if((rho <= 0) & ~F.isnan(rho)).alias("n_bad_density"), F.min(rho).alias("rho_min"), any_of(F.isnan).alias("n_nan"), any_of(infinite).alias("n_inf")]
