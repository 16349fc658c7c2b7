"""Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def nan_to_null(x: Column) -> Column:
    """The value as a double, null where it isn't finite."""
    x = x.cast("double")
    return F.when(finite(x), x)


def all_finite(vector: Column) -> Column:
    return F.forall(vector, lambda v: finite(v))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, of times with and without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def both_finite(x: Column, y: Column) -> tuple[Column, Column]:
    """The two as doubles, both null unless both are finite."""
    x, y = x.cast("double"), y.cast("double")
    ok = finite(x) & finite(y)
    return F.when(ok, x), F.when(ok, y)


def pearson(x: Column, y: Column, complete: bool = False) -> Column:
    """Correlation aggregate over the rows in which both are finite (all are, if ``complete``); null where a side is constant."""
    x, y = (x, y) if complete else both_finite(x, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def latitude(z: Column) -> Column:
    return F.degrees(F.asin(F.least(F.greatest(z, F.lit(-1.0)), F.lit(1.0))))


def longitude(x: Column, y: Column, positive: bool = False) -> Column:
    lon = F.degrees(F.atan2(y, x))
    return F.pmod(lon, F.lit(360.0)) if positive else lon


def chord(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0)))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def project(vector: Column, mean: list[float], basis: list[list[float]]) -> Column:
    """Scores of a centred vector on each row of the basis."""
    centred = F.zip_with(vector, F.array(*map(F.lit, map(float, mean))), lambda x, m: x.cast("double") - m)
    return F.array(*[dot(centred, F.array(*map(F.lit, map(float, w)))) for w in basis])


def shift_along(vector: Column, direction: Column, gamma: Column | float) -> Column:
    """The vector moved by gamma along a direction."""
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    return F.zip_with(vector, direction, lambda x, d: x.cast("double") + g * d)


def pick(vector: Column, positions: list[int]) -> Column:
    return F.array(*[F.get(vector, F.lit(p)) for p in positions])


def leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def day_of_year_365(ts: Column) -> Column:
    """0 to 364 in every year; null on 29 February."""
    d, year = F.dayofyear(ts), F.year(ts)
    return F.when(leap(year) & (d == 60), None).otherwise(d - 1 - F.when(leap(year) & (d > 60), 1).otherwise(0))


def nearest_six_hours(ts: Column) -> Column:
    """The day's nearest multiple of 6 hours to the hour (minutes dropped), halves to even."""
    return F.date_trunc("DAY", ts) + F.make_dt_interval(F.lit(0), (F.bround(F.hour(ts) / 6.0, 0) * 6).cast("int"))


def hours_between(a: Column, b: Column) -> Column:
    return (micros(a) - micros(b)) / 3.6e9


def lead_label(hours: Column) -> Column:
    days, rest = F.floor(hours / 24), hours % 24
    return F.when(hours < 24, F.format_string("%dh", hours)).when(rest == 0, F.format_string("%dd", days)).otherwise(F.format_string("%dd %dh", days, rest))


def solar_hour(ts: Column, lon: Column) -> Column:
    return F.pmod(F.hour(ts) + lon / 15.0, F.lit(24.0))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def elevation(geopotential: Column) -> Column:
    return geopotential / GRAVITY


def land(mask: Column) -> Column:
    return mask > 0.5


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def feature_name(field: Column, level: Column) -> Column:
    return F.when(level.isNull(), field).otherwise(F.format_string("%s_lev%02d", field, level))


def feature_field(name: Column) -> Column:
    return F.regexp_replace(name, "_lev[0-9]+$", "")


def feature_level(name: Column) -> Column:
    """The level index, null for a field without levels."""
    return F.expr("try_cast(NULL AS INT)") if name is None else F.when(name.rlike("_lev[0-9]+$"), F.regexp_extract(name, "_lev([0-9]+)$", 1).cast("int"))


def time_in_name(name: Column) -> Column:
    """``YYYY-MM-DD`` with or without an hour, wherever it stands in a file name."""
    day, hour = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}T(\d{2})", 1)
    return F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(hour == "", "00").otherwise(hour)), F.lit("yyyy-MM-dd HH"))


def layer_in_name(name: Column) -> Column:
    found = F.regexp_extract(name, r"layer(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def gamma_in_name(name: Column) -> Column:
    found = F.regexp_extract(name, r"gamma_(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def to_pascal(p: Column, largest: Column) -> Column:
    return F.when(largest < 2000, p * 100.0).otherwise(p)


def to_hectopascal(p: Column, largest: Column) -> Column:
    return F.when(largest > 2000, p / 100.0).otherwise(p)


def mask_time_in_name(name: Column) -> Column:
    """``YYYYMMDD`` or ``YYYYMMDD_HH`` (also with T or -) in a mask's file name; midnight without an hour."""
    day, hour = F.regexp_extract(name, r"(?<!\d)(\d{8})(?!\d)", 1), F.regexp_extract(name, r"(?<!\d)\d{8}[T_-](\d{2})", 1)
    day = F.when(day == "", F.regexp_extract(name, r"(?<!\d)(\d{8})[T_-]\d{2}", 1)).otherwise(day)
    return F.coalesce(F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(hour == "", "00").otherwise(hour)), F.lit("yyyyMMdd HH")), time_in_name(name))


def month_bounds(ts: Column) -> tuple[Column, Column]:
    """First day of the month, and of the next."""
    first = F.trunc(ts, "month")
    return first, F.add_months(first, 1)


def valid_time(center: Column, lead_hours: Column, stored: Column | None = None) -> Column:
    """The stored time where there is one, else the centre and the lead."""
    made = F.timestamp_micros(micros(center) + (lead_hours * 3_600_000_000).cast("long"))
    return made if stored is None else F.coalesce(stored.cast("timestamp"), made)


def log_grid(low: float, high: float, n: int) -> list[float]:
    """``n`` numbers from 10^low to 10^high, evenly spaced in the exponent."""
    return [10.0 ** (low + (high - low) * k / max(1, n - 1)) for k in range(n)]


def season_angles(ts: Column) -> tuple[Column, Column, Column, Column]:
    """Sine and cosine of the day of the year (from 0, over 365.25) and of the hour of the day."""
    return *cyclic(F.dayofyear(ts) - 1, 365.25), *cyclic(F.hour(ts), 24.0)


def component_name(k: Column) -> Column:
    return F.format_string("PC_%d", k)
