"""Joins: nearest in time, nearest or near in space, bins, lags, controls, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chord, micros


def asof_nearest(left: DataFrame, right: DataFrame, ts: str, other: str, tolerance_s: int, left_id: str, by: list[str] | None = None) -> DataFrame:
    """Left rows with the nearest ``other`` time within the tolerance (inclusive), the earliest on a tie; unmatched ones go.

    Both sides fall into buckets as wide as the tolerance. Within a bucket the
    last time before a row and the first after it come by windows over the
    union, one from each end; of the buckets beside it only the nearest time is
    needed. So no pairs are made, however many times are within the tolerance.
    ``left_id`` names a row for its readers; every left row gets its own answer.
    """
    width = max(1, tolerance_s) * 1_000_000
    keys = [f"_k{i}" for i in range(len(by or []))]
    there = lambda df: df.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*keys, "_t"))).withColumn("_b", F.floor(F.col("_t") / width))
    key = [F.col(c).alias(k) for c, k in zip(by or [], keys)]
    rows = there(left.select(F.struct("*").alias("_row"), *key, micros(F.col(ts)).alias("_t")))
    times = there(right.select(*key, F.col(other).alias("_r"), micros(F.col(other)).alias("_t")))
    ends = times.groupBy(*keys, "_b").agg(F.min_by("_r", "_t").alias("_lo"), F.max_by("_r", "_t").alias("_hi"))
    beside = lambda end, d: ends.select(*keys, (F.col("_b") + d).alias("_b"), F.col(end).alias("_r"), micros(F.col(end)).alias("_t"))
    both = rows.withColumn("_r", F.lit(None).cast(right.schema[other].dataType))
    for df in (times, beside("_lo", -1), beside("_hi", 1)):
        both = both.unionByName(df, allowMissingColumns=True)
    up_to = lambda order: F.last("_r", True).over(Window.partitionBy(*keys, "_b").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.select("_row", "_t", up_to(F.asc("_t")).alias("_before"), up_to(F.desc("_t")).alias("_after")).filter("_row IS NOT NULL")
    near = F.least(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_t") - micros(F.col(c))).alias("gap"), F.col(c).alias("time"))) for c in ("_before", "_after")])
    found = found.select("_row", near.alias("_m")).filter(F.col("_m.gap") <= tolerance_s * 1_000_000)
    return found.select("_row.*", F.col("_m.time").alias(other), (F.col("_m.gap") / 1e6).alias("gap_s"))


def asof_nearest_unbounded(left: DataFrame, right: DataFrame, ts: str, other: str) -> DataFrame:
    """As above without a tolerance: the last before and the first after, by windows over the union within pieces of the time range.

    What lies beyond a piece is its neighbours' nearest times, a row for each piece.
    """
    ends = right.agg(F.min(micros(F.col(other))).alias("low"), F.max(micros(F.col(other))).alias("high")).first()
    parts = 4 * max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    low, width = ends.low or 0, max(1, ((ends.high or 0) - (ends.low or 0)) // parts + 1)
    piece = lambda c: F.least(F.greatest(F.floor((micros(c) - low) / width), F.lit(-1)), F.lit(parts + 1)).cast("long")
    kind = right.schema[other].dataType
    spans = right.filter(F.col(other).isNotNull()).groupBy(piece(F.col(other)).alias("_p")).agg(F.min(other).alias("_lo"), F.max(other).alias("_hi"))
    spine = left.sparkSession.range(-1, parts + 2).select(F.col("id").alias("_p")).join(spans, "_p", "left")
    order = Window.orderBy("_p")
    spine = spine.select("_p", F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.min("_lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    both = left.withColumn("_t", F.col(ts)).withColumn("_r", F.lit(None).cast(kind))
    times = right.select(F.col(other)).distinct()
    both = both.unionByName(times.select(F.col(other).alias("_t"), F.col(other).alias("_r")), allowMissingColumns=True)
    both = both.withColumn("_p", piece(F.col("_t"))).join(F.broadcast(spine), "_p", "left")
    inside = Window.partitionBy("_p").orderBy("_t")
    before = F.coalesce(F.last("_r", True).over(inside.rangeBetween(Window.unboundedPreceding, 0)), F.col("_below"))
    after = F.coalesce(F.first("_r", True).over(inside.rangeBetween(0, Window.unboundedFollowing)), F.col("_above"))
    found = both.withColumn("_a", before).withColumn("_z", after).filter(F.col(ts).isNotNull())
    near = F.when(F.col("_a").isNull(), F.col("_z")).when(F.col("_z").isNull(), F.col("_a"))
    near = near.when(micros(F.col("_t")) - micros(F.col("_a")) <= micros(F.col("_z")) - micros(F.col("_t")), F.col("_a")).otherwise(F.col("_z"))
    return found.select(*left.columns, near.alias(other))


def grid_index(value: Column, first: float, step: float) -> Column:
    """Index of the nearest line of a regular axis."""
    return F.round((value - first) / step).cast("int")


def nearest_on_grid(points: DataFrame, grid: DataFrame, lat0: float, lat_step: float, lon0: float, lon_step: float, n_lon: int) -> DataFrame:
    """Each point with the grid's row at the nearest latitude and longitude (around the date line); an equi-join on indices."""
    key = lambda df: df.withColumn("_i", grid_index(F.col("lat"), lat0, lat_step)).withColumn("_j", F.pmod(grid_index(F.pmod(F.col("lon"), F.lit(360.0)), lon0, lon_step), F.lit(n_lon)))
    return key(points).join(key(grid).drop("lat", "lon"), ["_i", "_j"], "left").drop("_i", "_j")


def bin_cell(lat: Column, lon: Column, step: float = 2.5, keep_pole: bool = True) -> Column:
    """Cell number of right-open bins; null outside. ``keep_pole`` puts latitude 90 into the last row."""
    rows, cols = int(180 / step), int(360 / step)
    i, j = F.floor((lat + 90.0) / step), F.floor(F.pmod(lon, F.lit(360.0)) / step)
    i = F.when(lat == 90.0, rows - 1).otherwise(i) if keep_pole else i
    return F.when((i >= 0) & (i < rows) & lat.isNotNull() & lon.isNotNull(), (i * cols + j).cast("int"))


def radius_pairs(points: DataFrame, nodes: DataFrame, radius: float, point_id: str, node_id: str) -> DataFrame:
    """Pairs of points and nodes (unit ``x, y, z``) within the chord radius: cubes of that size, and their 26 neighbours."""
    cube = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    p = points.select(point_id, *[F.col(c).alias("p" + c) for c in "xyz"], *[cube(c).alias("c" + c) for c in "xyz"])
    n = nodes.select(node_id, *[F.col(c).alias("n" + c) for c in "xyz"], *[cube(c).alias("c" + c) for c in "xyz"])
    for c in "xyz":
        n = n.withColumn("d", F.explode(near)).withColumn("c" + c, F.col("c" + c) + F.col("d")).drop("d")
    d = chord(tuple(F.col("p" + c) for c in "xyz"), tuple(F.col("n" + c) for c in "xyz"))
    return p.join(n, ["cx", "cy", "cz"]).withColumn("chord", d).filter(F.col("chord") <= radius).select(point_id, node_id, "chord")


def match_by_place(a: DataFrame, b: DataFrame, digits: int = 8, strict: bool = False) -> DataFrame:
    """Rows of ``a`` joined to those of ``b`` at the same rounded ``x, y, z``; if ``strict``, exactly one for each or an error."""
    if strict:
        on = [F.round(F.col(c), digits).alias("_" + c) for c in "xyz"]
        there = b.groupBy(*on).agg(F.count("*").alias("_n"))
        wrong = a.select(*on).join(there, ["_x", "_y", "_z"], "left").agg(F.count_if(F.col("_n").isNull()).alias("none"), F.count_if(F.col("_n") > 1).alias("many")).first()
        if wrong.none or wrong.many:
            raise ValueError(f"{wrong.none} places without a match, {wrong.many} with several")
    key = lambda df: df.select("*", *[F.round(F.col(c), digits).alias("_" + c) for c in "xyz"])
    return key(a).join(key(b).drop("x", "y", "z"), ["_x", "_y", "_z"]).drop("_x", "_y", "_z")


def missing_steps(df: DataFrame, ts: str, start, end, step: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Times of the half-open sequence that no row has; with keys, for each of their values in the rows."""
    kind = df.schema[ts].dataType
    ends = [F.lit(start).cast(kind), F.lit(end).cast(kind)]
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(*ends, F.expr(f"INTERVAL {step}"))).alias(ts)).filter(F.col(ts) < ends[1])
    if keys:
        spine = df.select(*keys).distinct().crossJoin(F.broadcast(spine))
    on = [F.col("s." + k).eqNullSafe(F.col("d." + k)) for k in (*keys, ts)]
    return spine.alias("s").join(df.select(*keys, ts).distinct().alias("d"), on, "left_anti")


def against_control(df: DataFrame, keys: list[str], label: str, control, value: str) -> DataFrame:
    """Each row less the control's row at the same keys; rows without one go."""
    base = df.filter(F.col(label) == F.lit(control)).select(*keys, F.col(value).alias("control_value"))
    return df.join(base, keys).withColumn("delta", F.col(value) - F.col("control_value"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Steps numbered from 0; for one row per step."""
    return df.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1)


def lag_pairs(steps: DataFrame, lags: list[int], circular: bool = False) -> DataFrame:
    """Numbered steps (``i`` and more) joined to those ``lag`` later; round the end if circular."""
    n = steps.count()
    lag = F.explode(F.array(*map(F.lit, lags))).alias("lag")
    a = steps.select("*", lag)
    to = F.pmod(F.col("i") + F.col("lag"), F.lit(max(1, n))) if circular else F.col("i") + F.col("lag")
    b = steps.select(*[F.col(c).alias(c + "_later") for c in steps.columns])
    return a.withColumn("_to", to.cast("int")).join(b, F.col("_to") == F.col("i_later")).drop("_to")


def with_neighbours(df: DataFrame, ts: str, step: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct times of which both the one before and the one after exist; with keys, among the rows of the same keys."""
    t = df.select(*keys, ts).distinct()
    for sign in (1, -1):
        moved = t.select(*keys, (F.col(ts) + sign * F.expr(f"INTERVAL {step}")).alias(ts)).alias("d")
        out = t if sign == 1 else out
        on = [F.col("s." + k).eqNullSafe(F.col("d." + k)) for k in keys] + [F.col("s." + ts) == F.col("d." + ts)]
        out = out.alias("s").join(moved, on, "left_semi")
    return out


def join_all(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows joined on the keys; an error if one has no partner."""
    lost = left.join(right.select(*keys).distinct(), keys, "left_anti").limit(1).count()
    if lost:
        raise ValueError(f"rows without a partner at {', '.join(keys)}")
    return left.join(right, keys)


def other_node_sets(df: DataFrame, step: str, node: str) -> DataFrame:
    """Steps whose set of nodes isn't that of the first step, or that have a node twice: ``step, nodes, rows``."""
    each = df.groupBy(step).agg(F.count("*").alias("rows"), F.count_distinct(node).alias("nodes"), F.sum(F.xxhash64(F.col(node)).cast("decimal(38,0)")).alias("_h"))
    first = each.agg(F.min_by("nodes", step).alias("_n1"), F.min_by("_h", step).alias("_h1"))
    return each.crossJoin(F.broadcast(first)).filter((F.col("nodes") != F.col("_n1")) | (F.col("_h") != F.col("_h1")) | (F.col("rows") != F.col("nodes"))).select(step, "nodes", "rows")


def complete_windows(starts: DataFrame, steps: DataFrame, ts: str, before_steps: int, after_steps: int, step: str = "6 HOURS") -> DataFrame:
    """Starts with every step from ``before_steps`` before to ``after_steps`` after them: what a forecast needs."""
    want = F.explode(F.sequence(F.lit(-before_steps), F.lit(after_steps)))
    asks = starts.select(ts).distinct().select(F.col(ts).alias("_s"), want.alias("_k")).select("_s", (F.col("_s") + F.col("_k") * F.expr(f"INTERVAL {step}")).alias(ts))
    full = asks.join(steps.select(ts).distinct(), ts).groupBy("_s").agg(F.count("*").alias("_n")).filter(F.col("_n") == before_steps + after_steps + 1)
    return full.select(F.col("_s").alias(ts))


def require_window(starts: DataFrame, steps: DataFrame, ts: str, before_steps: int, after_steps: int, step: str = "6 HOURS") -> None:
    """An error if a start lacks one of its steps."""
    lost = starts.select(ts).distinct().join(complete_windows(starts, steps, ts, before_steps, after_steps, step), ts, "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0][0]} lacks a step")


def first_usable_step(starts: DataFrame, marks: DataFrame, ts: str, mark: str, steps: int, tolerance_s: int, step_s: int = 21600, backward: bool = False) -> DataFrame:
    """Per start the first of its ``steps`` (from 0 on, or the last, if ``backward``) with a mark within the tolerance: ``ts, step, mark``."""
    at = starts.select(ts).distinct().select(F.col(ts).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    at = at.withColumn("_at", F.timestamp_micros(micros(F.col("_s")) + F.col("step") * (step_s * 1_000_000))).withColumn("_id", F.struct("_s", "step"))
    found = asof_nearest(at, marks, "_at", mark, tolerance_s, "_id")
    end = (F.max if backward else F.min)(F.struct("step", mark))
    return found.groupBy("_s").agg(end.alias("_e")).select(F.col("_s").alias(ts), "_e.step", F.col("_e")[mark].alias(mark))


def starts_with_both_ends(starts: DataFrame, marks: DataFrame, ts: str, mark: str, first_s: int, last_s: int, tolerance_s: int) -> DataFrame:
    """Starts that have a mark within the tolerance of both ``first_s`` and ``last_s`` after them."""
    out = starts.select(ts).distinct()
    for k, off in enumerate((first_s, last_s)):
        ends = out.withColumn("_at", F.timestamp_micros(micros(F.col(ts)) + off * 1_000_000)).withColumn("_id", F.col(ts))
        out = asof_nearest(ends, marks, "_at", mark, tolerance_s, "_id").select(*[c for c in out.columns], F.col(mark).alias(f"mark_{k}"))
    return out
