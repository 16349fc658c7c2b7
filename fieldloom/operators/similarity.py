"""Similarity of maps over time. A map is an array column, one row for each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, dot, norm, ratio
from .joins import lag_pairs


def standardised(vector: Column, eps: float = 1e-8) -> Column:
    n = F.size(vector)
    add = lambda s, v: s + v.cast("double")
    mean = F.aggregate(vector, F.lit(0.0), add) / n
    std = F.sqrt(F.aggregate(F.transform(vector, lambda v: (v - mean) * (v - mean)), F.lit(0.0), add) / n)
    return F.transform(vector, lambda v: (v - mean) / (std + eps))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def symmetric(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Mean product over the mean of the two mean squares."""
    n = F.size(a)
    return dot(a, b) / n / ((dot(a, a) + dot(b, b)) / n / 2 + eps)


def lag_curve(steps: DataFrame, vector: str, lags: list[int], circular: bool = False, measure=cosine) -> DataFrame:
    """Mean, population deviation and number of the similarities at each lag; only the wanted diagonals are made."""
    pairs = lag_pairs(steps, lags, circular).withColumn("sim", measure(F.col(vector), F.col(vector + "_later")))
    return pairs.groupBy("lag").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"), F.count("*").alias("pairs"))


def all_pairs(steps: DataFrame, vector: str) -> DataFrame:
    """Correlation of every pair of steps, as a matrix in long form; as large as the square of the steps."""
    z = steps.select("i", standardised(F.col(vector)).alias("z"))
    return z.crossJoin(z.select(F.col("i").alias("j"), F.col("z").alias("other"))).select("i", "j", clip(dot(F.col("z"), F.col("other")) / F.size("z"), -1.0, 1.0).alias("sim"))


def off_diagonal(matrix: DataFrame, lags: list[int]) -> DataFrame:
    s = F.when(F.col("i") != F.col("j"), F.col("sim"))
    at = [F.avg(F.when(F.col("j") - F.col("i") == k, F.col("sim"))).alias(f"lag_{k}") for k in lags]
    return matrix.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), *at)


def group_pair_means(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean dot product of all pairs of rows of two groups, a row not with itself.

    By sums: no pair of rows is ever made. Null where a group has one row only.
    """
    long = df.select(group, F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    sums = long.groupBy(group, "pos").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    s = sums.join(n, group)
    pairs = s.select(F.col(group).alias("a"), "pos", "s", "q", "n").join(s.select(F.col(group).alias("b"), "pos", F.col("s").alias("s2"), F.col("n").alias("n2")), "pos")
    same = F.col("a") == F.col("b")
    total = F.sum(F.when(same, F.col("s") * F.col("s") - F.col("q")).otherwise(F.col("s") * F.col("s2")))
    count = F.max(F.when(same, F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("n2")))
    return pairs.groupBy("a", "b").agg(ratio(total, count).alias("sim"))


def diurnal_scores(pairs: DataFrame, slots: int = 4) -> DataFrame:
    """From slot pairs: mean of equal slots, of opposite ones, and the difference."""
    gap = F.pmod(F.col("b") - F.col("a"), F.lit(slots))
    same, opposite = F.avg(F.when(gap == 0, F.col("sim"))), F.avg(F.when(gap == slots // 2, F.col("sim")))
    return pairs.agg(same.alias("same"), opposite.alias("opposite"), (same - opposite).alias("contrast"))


def diurnal_lag_curve(pairs: DataFrame, slots: int = 4) -> DataFrame:
    """From slot pairs: the mean similarity at each shift of slots round the day."""
    return pairs.groupBy(F.pmod(F.col("b") - F.col("a"), F.lit(slots)).cast("int").alias("shift")).agg(F.avg("sim").alias("mean"))


def periodicity(steps: DataFrame, value: str, period: float) -> DataFrame:
    """Share of the power, mean left out, at the frequency nearest to one per period; by one DFT line and Parseval."""
    n = steps.count()
    k = max(1, round(n / period)) if n else 1
    mean = steps.agg(F.avg(value)).first()[0] or 0.0
    angle, v = F.col("i") * (2 * 3.141592653589793 * k / max(n, 1)), F.col(value) - mean
    line = F.pow(F.sum(v * F.cos(angle)), F.lit(2)) + F.pow(F.sum(v * F.sin(angle)), F.lit(2))
    # A real series has its power twice but for the middle line; one side is compared with one side.
    return steps.agg((line / (F.sum(v * v) * n / 2 + 1e-8)).alias("share"))


def lag_rankings(curve: DataFrame, key: str) -> DataFrame:
    """Per component, from ``lag`` (days) and ``mean``: stability, change and seasonal score; null where a lag is absent."""
    at = lambda d: F.avg(F.when(F.col("lag") == d, F.col("mean")))
    return curve.groupBy(key).agg(F.avg(F.when(F.col("lag").isin(1, 7, 30), F.col("mean"))).alias("stability"), (at(1) - at(30)).alias("change"), (at(365) - at(180)).alias("seasonal"))
