"""Filters: time, position, validity, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import all_finite


def keep_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def between(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows of the half-open range; literal bounds reach the scan."""
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def _steps(df: DataFrame, ts: str) -> DataFrame:
    # One row for each time; a window over all of them is one small task.
    return df.select(ts).distinct().withColumn("_n", F.row_number().over(Window.orderBy(ts)))


def first_steps(df: DataFrame, ts: str, k: int) -> DataFrame:
    """Rows of the first k distinct times: all those up to the k-th."""
    keep = df.select(ts).distinct().orderBy(ts).limit(k)
    return df.join(F.broadcast(keep) if k <= 100_000 else keep, ts, "left_semi")


def first_days(df: DataFrame, ts: str, days: int, start=None) -> DataFrame:
    rows = df if start is None else df.filter(F.to_date(ts) >= F.lit(start))
    keep = rows.select(F.to_date(ts).alias("_day")).distinct().orderBy("_day").limit(days)
    return rows.join(F.broadcast(keep), F.to_date(ts) == F.col("_day"), "left_semi")


def split_by_position(df: DataFrame, ts: str, share: float) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by the position of their time; validation is the last training step if none is left."""
    steps = _steps(df, ts)
    n = steps.count()
    cut = max(1, int(n * share))
    train = steps.filter(F.col("_n") <= cut).select(ts)
    valid = steps.filter(F.col("_n") > cut if cut < n else F.col("_n") == n).select(ts)
    return df.join(train, ts, "left_semi"), df.join(valid, ts, "left_semi")


def first_in_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def sample_per_group(df: DataFrame, keys: list[str], ident: str, most: int, seed: int = 0) -> DataFrame:
    """At most so many rows of each group, the first in the order of a hash."""
    return first_in_group(df, keys, [F.xxhash64(F.lit(seed), *keys, ident), ident], most)


def complete_steps(df: DataFrame, ts: str, vector: str) -> DataFrame:
    """Whole steps only: those of which any number isn't finite go."""
    bad = df.filter(~all_finite(F.col(vector)) | F.col(vector).isNull()).select(ts).distinct()
    return df.join(bad, ts, "left_anti")


def complete_rows(df: DataFrame, vectors: list[str]) -> DataFrame:
    return df.filter(F.expr("true") if not vectors else _all([all_finite(F.col(v)) & F.col(v).isNotNull() for v in vectors]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def require_no_rows(df: DataFrame, message: str) -> None:
    """Raise if there is a row."""
    if df.limit(1).count():
        raise ValueError(message)


def nearest_level(levels: DataFrame, level: str, targets: DataFrame, target: str) -> DataFrame:
    """For each target the nearest level, of ties the smaller."""
    pairs = targets.crossJoin(F.broadcast(levels.select(level).distinct()))
    return pairs.groupBy(target).agg(F.min_by(level, F.struct(F.abs(F.col(level) - F.col(target)), F.col(level))).alias(level))


def every_nth(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter((F.col("_n") - 1) % n == 0).drop("_n")


def scramble(df: DataFrame, vector: str, seed: int = 0) -> DataFrame:
    """Each row's vector in a random order that its numbers and the seed decide, however rows are partitioned: a null test."""
    order = F.transform(F.col(vector), lambda v, i: F.struct(F.xxhash64(F.lit(seed), F.col(vector), i).alias("h"), i.alias("i"), v.alias("v")))
    return df.withColumn(vector, F.transform(F.array_sort(order), lambda s: s["v"]))


def before_and_from(df: DataFrame, ts: str, date) -> tuple[DataFrame, DataFrame]:
    """Rows before a date, and from it on."""
    return df.filter(F.col(ts) < F.lit(date)), df.filter(F.col(ts) >= F.lit(date))


def at_hours(df: DataFrame, ts: str, hours: list[int]) -> DataFrame:
    return df.filter(F.hour(ts).isin(*hours))


def outside_year(df: DataFrame, ts: str, year: int) -> DataFrame:
    """Rows whose time is in another year; null times are none."""
    return df.filter((F.col(ts) < F.lit(f"{year}-01-01")) | (F.col(ts) >= F.lit(f"{year + 1}-01-01")))


def up_to_level(df: DataFrame, nodes: DataFrame, node: str, level: int, only: bool = False) -> DataFrame:
    """Rows of the nodes that a mesh level has, or that are new in it; the nodes are a mesh's, a fixed table."""
    have = nodes.filter(F.col("first_level") == level if only else F.col("first_level") <= level)
    return df.join(have.select(node), node, "left_semi")


def by_level_map(targets: DataFrame, levels: DataFrame, level: str) -> DataFrame:
    """Targets with the index that their exact level has in a table of levels; others go."""
    return targets.join(levels, level)


def explained_and_not(results: DataFrame, r2: str, well: float = 0.5, badly: float = 0.3) -> DataFrame:
    """Results whose R2 is at least ``well``, or below ``badly``, with ``list``: which of the two."""
    return results.withColumn("list", F.when(F.col(r2) >= well, "well").when(F.col(r2) < badly, "badly")).filter("list IS NOT NULL")


def select_leads(df: DataFrame, keys: list[str], lead: str, which: str, batch: str | None = None) -> DataFrame:
    """Rows of batch 0 at ``all`` leads, or the ``first`` or ``last`` of each key."""
    if which not in ("all", "first", "last"):
        raise ValueError(f"all, first or last, not {which!r}")
    df = df if batch is None else df.filter(F.col(batch) == 0)
    if which == "all":
        return df
    end = df.groupBy(*[F.col(k).alias("_k_" + k) for k in keys]).agg((F.min if which == "first" else F.max)(lead).alias("_lead"))
    return df.join(end, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys] + [F.col(lead) == F.col("_lead")], "left_semi")


def rename_if_absent(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new) if new not in df.columns else df
