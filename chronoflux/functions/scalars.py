"""Scalar column functions: time scales, event classes, coordinates, rounding, grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epoch offsets of the supported time scales.
MJD_OF_UNIX_EPOCH = 40587.0
JULIAN_OF_UNIX_EPOCH = 2440587.5
J2000_NOON_UNIX = 946728000
SECONDS_PER_DAY = 86400

# Event class letters in rising order; rank 0 means "no class".
CLASS_LETTERS = ("B", "C", "M", "X")
CLASS_PATTERN = r"(?i)^([BCMX])([\d.]+)$"
LOCATION_PATTERN = r"^([NS])(\d{2})([EW])(\d{2})$"
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def correlation(x: str, y: str) -> Column:
    """Pearson's r over the rows that have both; NaN if either has no spread, null without rows.

    Spark's ``corr`` divides by the spread and fails on zero in ANSI mode.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    return F.when(spread.isNotNull(), F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(float("nan"))))


# --- time scales -----------------------------------------------------------
def mjd_to_unix(mjd: str | Column) -> Column:
    return (col(mjd) - F.lit(MJD_OF_UNIX_EPOCH)) * SECONDS_PER_DAY


def julian_to_date(jd: str | Column) -> Column:
    seconds = (col(jd) - F.lit(JULIAN_OF_UNIX_EPOCH)) * SECONDS_PER_DAY
    return F.to_date(F.timestamp_seconds(seconds))


def j2000_to_timestamp(seconds: str | Column) -> Column:
    micros = F.round((col(seconds) + J2000_NOON_UNIX) * 1_000_000).cast("bigint")
    return F.timestamp_micros(micros)


def unix_of(ts: str | Column) -> Column:
    """Whole unix seconds (floor) of a timestamp; zone-less stamps are read as UTC."""
    return F.floor(F.unix_micros(col(ts).cast("timestamp")) / F.lit(1_000_000)).cast("bigint")


def utc_of(t: str | Column) -> Column:
    return F.timestamp_seconds(col(t))


def second_of_day(t: str | Column) -> Column:
    return F.pmod(col(t), F.lit(SECONDS_PER_DAY))


def day_index(t: str | Column) -> Column:
    """Days since 1970-01-01; the integer partition key of every day table."""
    return floor_div(t, SECONDS_PER_DAY)


def day_key(t: str | Column) -> Column:
    return F.date_format(utc_of(t), "yyyyMMdd")


def day_key_to_date(key: str | Column) -> Column:
    return F.to_date(col(key), "yyyyMMdd")


def floor_div(c: str | Column, n: int | Column) -> Column:
    """Integer floor division that also rounds down for negative numbers."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(col(c) / n).cast("bigint")


# --- event classes ---------------------------------------------------------
def class_letter(text: str | Column) -> Column:
    letter = F.upper(F.regexp_extract(F.trim(col(text)), CLASS_PATTERN, 1))
    return F.when(class_magnitude(text).isNotNull(), letter)


def class_magnitude(text: str | Column) -> Column:
    digits = F.regexp_extract(F.trim(col(text)), CLASS_PATTERN, 2)
    return F.when(digits != "", digits).try_cast("double")


def class_rank(letter: str | Column) -> Column:
    """B 1, C 2, M 3, X 4, anything else (also null) 0."""
    ranks = F.when(F.lit(False), F.lit(0))
    for i, name in enumerate(CLASS_LETTERS, start=1):
        ranks = ranks.when(col(letter) == name, F.lit(i))
    return ranks.otherwise(F.lit(0))


def rank_letter(rank: str | Column) -> Column:
    letters = F.array(*[F.lit(x) for x in CLASS_LETTERS])
    return F.when(col(rank) > 0, F.get(letters, (col(rank) - 1).cast("int")))


# --- coordinates and names -------------------------------------------------
def latitude(location: str | Column) -> Column:
    c = F.trim(col(location))
    degrees = F.regexp_extract(c, LOCATION_PATTERN, 2).try_cast("double")
    return F.when(F.regexp_extract(c, LOCATION_PATTERN, 1) == "S", -degrees).otherwise(degrees)


def longitude(location: str | Column) -> Column:
    c = F.trim(col(location))
    degrees = F.regexp_extract(c, LOCATION_PATTERN, 4).try_cast("double")
    return F.when(F.regexp_extract(c, LOCATION_PATTERN, 3) == "E", -degrees).otherwise(degrees)


def satellite_number(name: str | Column) -> Column:
    return F.regexp_extract(col(name), r"g(\d{2})", 1).try_cast("bigint")


def human_bytes(n: str | Column) -> Column:
    """``1536`` -> ``1.5 KB``; beyond TB the unit stays PB; ties round to even."""
    value = col(n).cast("double")
    out = None
    for i, unit in enumerate(BYTE_UNITS):
        scaled = value / float(1024**i)
        text = F.format_string(f"%.1f {unit}", F.bround(scaled, 1))
        out = F.when(scaled < 1024, text) if out is None else out.when(scaled < 1024, text)
    return out.otherwise(F.format_string("%.1f PB", F.bround(value / float(1024**5), 1)))


# --- numbers ---------------------------------------------------------------
def finite(c: str | Column) -> Column:
    """NaN and infinities become null; applied once at the door of every table."""
    v = col(c)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def json_round(c: str | Column, digits: int = 2) -> Column:
    return F.round(finite(c), digits)


def geometric_grid(low: float | Column, high: float | Column, n: int) -> Column:
    """Array of ``n`` geometrically spaced numbers, both ends included."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    step = F.log(high / low) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low * F.exp(i * step))


# Acklam's published rational approximation of the normal quantile.
_ACKLAM_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
             1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
_ACKLAM_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
             6.680131188771972e1, -1.328068155288572e1, 1.0)
_ACKLAM_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838,
             -2.549732539343734, 4.374664141464968, 2.938163982698783)
_ACKLAM_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996,
             3.754408661907416, 1.0)


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_upper_quantile(p: str | Column) -> Column:
    """x with P(N(0,1) > x) = p, for 0 < p <= 0.5 (absolute error near 1e-9 of x)."""
    p = col(p)
    q = F.sqrt(-2.0 * F.log(p))
    tail = -_poly(_ACKLAM_C, q) / _poly(_ACKLAM_D, q)
    r = p - 0.5
    s = r * r
    centre = -(_poly(_ACKLAM_A, s) * r / _poly(_ACKLAM_B, s))
    return F.when(p < 0.02425, tail).otherwise(centre)
