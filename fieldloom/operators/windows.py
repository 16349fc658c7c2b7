"""Window-like operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import GRAVITY

#: Groups of which there are no more than this are broadcast to their rows.
GROUPS = 100_000


def zscore(df: DataFrame, keys: list[str], value: str, eps: float = 1e-8) -> DataFrame:
    """Rows meet their group's mean and deviation, which are broadcast while they are few; rows aren't shuffled then."""
    out = with_group(df, keys, F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return out.withColumn("z", (F.col(value) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def unit_norm(df: DataFrame, keys: list[str], value: str, center: bool = True, floor: float = 1e-8) -> DataFrame:
    v = F.col(value).cast("double")
    length = F.sqrt(F.var_pop(v) * F.count(v) if center else F.sum(v * v))
    out = with_group(df, keys, F.avg(v).alias("_m"), length.alias("_s"))
    return out.withColumn("unit", (v - F.col("_m") if center else v) / F.greatest("_s", F.lit(floor))).drop("_m", "_s")


def with_group(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Each row with its group's aggregates; null is a key like others."""
    stats = df.groupBy(*[F.col(k).alias("_k_" + k) for k in keys]).agg(*aggregates)
    small = stats.limit(GROUPS + 1).count() <= GROUPS
    on = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys]
    return df.join(F.broadcast(stats) if small else stats, on, "left").drop(*["_k_" + k for k in keys])


def running_sums(df: DataFrame, order: str, names: list[str], descending: bool = False, before: bool = False, pieces: int = 64) -> DataFrame:
    """``run_<name>``: sums up to each row (``before``: without it), over rows with distinct values of a numeric ``order``.

    The range is cut at about even quantiles; sums of the pieces run first, then
    those within each, so no task sees all rows.
    """
    cuts = sorted(set(df.approxQuantile(order, [k / pieces for k in range(1, pieces)], 0.005)))
    piece = F.coalesce(F.array_position(F.transform(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col(order) <= c), F.lit(True)), F.lit(0)) if cuts else F.lit(0)
    piece = F.when(piece == 0, len(cuts) + 1).otherwise(piece)
    cut = df.withColumn("_p", (-piece if descending else piece).cast("long"))
    whole = cut.groupBy("_p").agg(*[F.sum(n).alias("_t_" + n) for n in names])
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over the pieces alone
    whole = whole.select("_p", *[F.coalesce(F.sum("_t_" + n).over(ahead), F.lit(0)).alias("_a_" + n) for n in names])
    within = Window.partitionBy("_p").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = cut.join(F.broadcast(whole), "_p")
    return out.withColumns({"run_" + n: F.col("_a_" + n) + F.coalesce(F.sum(n).over(within), F.lit(0)) for n in names}).drop("_p", *["_a_" + n for n in names])


def trapezoid(df: DataFrame, keys: list[str], x: str, y: Column) -> DataFrame:
    """Integral of y over x in each group, along ascending x."""
    w = Window.partitionBy(*keys).orderBy(x)
    parts = df.withColumn("_y", y).withColumn("_dx", F.lead(x).over(w) - F.col(x)).withColumn("_next", F.lead("_y").over(w))
    return parts.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_dx") * (F.col("_y") + F.col("_next")) / 2), F.lit(0.0)).alias("integral"))


def vapour_transport(df: DataFrame, keys: list[str], pressure: str = "level", q: str = "q", u: str = "u", v: str = "v") -> DataFrame:
    """Length of the vertical integrals of qu and qv over pressure (Pa), by gravity."""
    one = trapezoid(df, keys, pressure, F.col(q) * F.col(u)).withColumnRenamed("integral", "qu")
    two = trapezoid(df, keys, pressure, F.col(q) * F.col(v)).withColumnRenamed("integral", "qv")
    return one.join(two, keys).select(*keys, (F.hypot("qu", "qv") / GRAVITY).alias("ivt"))


def ranked(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Place in the group from 1, the largest score first; null and NaN come last."""
    known = F.when(~F.isnan(F.col(score)), F.col(score))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(known), tie)))


def event_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """Matched events numbered from 0 in order; for one row an event."""
    return df.withColumn("event_number", F.row_number().over(Window.orderBy(*order)) - 1)


def first_last(df: DataFrame, keys: list[str], order: str, first: bool) -> DataFrame:
    key = F.col(order).asc() if first else F.col(order).desc()
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(key))).filter("_n = 1").drop("_n")
