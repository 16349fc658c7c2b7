"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import feature_level, finite, nan_to_null, ratio


def vector_mean(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean at every position of the vectors of each group: ``keys, pos, mean``."""
    long = df.select(*keys, F.posexplode(vector).alias("pos", "v"))
    return long.groupBy(*keys, "pos").agg(F.avg(nan_to_null(F.col("v"))).alias("mean"))


def group_delta(df: DataFrame, vector: str, one: Column, two: Column) -> DataFrame:
    """Per position the mean of the rows where ``one`` holds less that where ``two`` holds."""
    long = df.select(one.alias("a"), two.alias("b"), F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy("pos").agg((F.avg(F.when(F.col("a"), F.col("v"))) - F.avg(F.when(F.col("b"), F.col("v")))).alias("delta"))


def step_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = nan_to_null(F.col(value))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(F.abs(v)).alias("mean_abs"))


def cell_mean(df: DataFrame, cell: str, value: str) -> DataFrame:
    """Mean of the finite values of a cell; cells without any have no row."""
    return df.filter(finite(F.col(value)) & F.col(cell).isNotNull()).groupBy(cell).agg(F.avg(F.col(value).cast("double")).alias("mean"), F.count("*").alias("n"))


def radius_mean(pairs: DataFrame, nodes: DataFrame, node: str, value: str) -> DataFrame:
    """Sum of the finite neighbours over the number of all; 0 for a node without any."""
    sums = pairs.groupBy(node).agg(F.sum(nan_to_null(F.col(value))).alias("s"), F.count("*").alias("n"))
    return nodes.select(node).join(sums, node, "left").select(node, (F.coalesce("s", F.lit(0.0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("mean"), F.coalesce("n", F.lit(0)).alias("neighbours"))


def weighted_mean(value: Column, weight: Column, mask: Column | None = None) -> Column:
    ok = finite(value) & finite(weight) if mask is None else finite(value) & finite(weight) & mask
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def colour_limit(value: Column, share: float = 0.99, floor: float = 1e-6) -> Column:
    return F.greatest(F.percentile(F.abs(value), F.lit(share)), F.lit(floor))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bin`` from 0 and ``n`` over equal bins between the extremes; the largest value is in the last bin."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    b = F.least(F.floor(ratio((F.col(value) - F.col("low")) * bins, F.col("high") - F.col("low"), 0.0)), F.lit(bins - 1))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def screening_summary(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """From ``abs_r, rank`` per step: mean, number of steps, wins."""
    return ranked.filter(F.col("abs_r").isNotNull()).groupBy(*keys).agg(F.avg("abs_r").alias("mean_abs_r"), F.count("*").alias("count"), F.count_if(F.col("rank") == 1).alias("wins"))


def cumulative_share(df: DataFrame, value: str, order: list) -> DataFrame:
    whole = Window.partitionBy()
    return df.withColumn("share", F.col(value) / F.sum(value).over(whole)).withColumn("cum", F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(whole))


def combine_annotators(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Intersection, union and mean of the annotators' labels at each place."""
    return df.groupBy(*keys).agg(F.min(label).alias("intersection"), F.max(label).alias("union"), F.avg(label).alias("soft"))


def quality_report(df: DataFrame, ts: str, vector: str) -> DataFrame:
    """Per step: rows, widths, numbers that are not finite."""
    bad = F.size(F.filter(vector, lambda v: ~finite(v)))
    return df.groupBy(ts).agg(F.count("*").alias("rows"), F.count_distinct(F.size(vector)).alias("widths"), F.sum(bad).alias("not_finite"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def incomplete_days(df: DataFrame, ts: str, start, end, expected: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Days of the closed range whose number of distinct times is another than expected, days without any too; with keys, for each of their values in the rows."""
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    if keys:
        spine = df.select(*keys).distinct().crossJoin(F.broadcast(spine))
    have = df.select(*keys, F.to_date(ts).alias("day"), ts).distinct().groupBy(*keys, "day").agg(F.count("*").alias("n")).alias("h")
    on = [F.col("s." + k).eqNullSafe(F.col("h." + k)) for k in (*keys, "day")]
    out = spine.alias("s").join(have, on, "left").select(*[F.col("s." + k).alias(k) for k in (*keys, "day")], F.coalesce("n", F.lit(0)).alias("n"))
    return out.filter(F.col("n") != expected)


def importance_by_field(df: DataFrame, name: str, coef: str) -> DataFrame:
    field = F.regexp_replace(name, "_lev[0-9]+$", "")
    return df.groupBy(field.alias("field")).agg(F.sum(F.abs(F.col(coef))).alias("importance"))


def importance_by_level(df: DataFrame, name: str, coef: str) -> DataFrame:
    """By level index as text, ``static`` for fields without levels."""
    level = F.coalesce(feature_level(F.col(name)).cast("string"), F.lit("static"))
    return df.groupBy(level.alias("level")).agg(F.sum(F.abs(F.col(coef))).alias("importance"))


def importance_by_band(df: DataFrame, name: str, coef: str) -> DataFrame:
    """By lower, mid and upper third of the level indices present; ``static`` for fields without levels."""
    leveled = df.withColumn("_l", feature_level(F.col(name)))
    bands = level_bands(leveled, "_l")  # a row for each level
    return leveled.join(F.broadcast(bands), "_l", "left").groupBy(F.coalesce("band", F.lit("static")).alias("band")).agg(F.sum(F.abs(F.col(coef))).alias("importance"))


def correlation_summary(screened: DataFrame, keys: list[str], r: str = "r") -> DataFrame:
    """Over the steps: mean correlation, mean and largest size, number of steps that have one."""
    v = nan_to_null(F.col(r))
    return screened.groupBy(*keys).agg(F.avg(v).alias("mean_corr"), F.avg(F.abs(v)).alias("mean_abs"), F.max(F.abs(v)).alias("max_abs"), F.count(v).alias("count"))


def neighbour_counts(pairs: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Smallest, middle and largest number of neighbours of all nodes, those without any too."""
    n = nodes.select(node).join(pairs.groupBy(node).agg(F.count("*").alias("n")), node, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.min("n").alias("min"), F.median("n").alias("median"), F.max("n").alias("max"))


def class_balance(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    y = F.col(label).cast("double")
    return df.groupBy(*keys).agg(F.count(label).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(y).alias("rate"))


def day_climatology(df: DataFrame, day: str, value: str, least_bins: int = 300) -> DataFrame:
    """Mean and number of each of the 365 days; an error if fewer than ``least_bins`` of them have a row."""
    out = df.filter(F.col(day).isNotNull()).groupBy(day).agg(F.avg(nan_to_null(F.col(value))).alias("mean"), F.count("*").alias("n"))
    bins = out.count()
    if bins < least_bins:
        raise ValueError(f"only {bins} of the days of the year have rows; {least_bins} are needed")
    return out


def strongest(df: DataFrame, columns: list[str], out: str = "strongest") -> DataFrame:
    """The name of the column with the number of largest size (of ties the first named), and that number; null without any."""
    cells = F.array(*[F.struct(F.abs(nan_to_null(F.col(c))).alias("size"), F.lit(-k).alias("k"), F.lit(c).alias("name"), nan_to_null(F.col(c)).alias("value")) for k, c in enumerate(columns)])
    best = F.array_max(F.filter(cells, lambda s: s["size"].isNotNull()))
    return df.withColumn(out, best["name"]).withColumn(out + "_value", best["value"])


def level_bands(df: DataFrame, level: str) -> DataFrame:
    """Levels present and their band: the first third by position is lower, the next mid, the last upper."""
    levels = df.select(level).filter(F.col(level).isNotNull()).distinct()
    numbered = levels.withColumn("i", F.row_number().over(Window.orderBy(level)) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return numbered.select(level, F.when(F.col("i") < third, "lower").when(F.col("i") < 2 * third, "mid").otherwise("upper").alias("band"))
