"""Scalar Column expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage codegen.
Under ANSI mode (the 4.x default) plain ``cast`` and ``to_timestamp`` raise on bad
input; every parser here uses the ``try_*`` form and yields NULL instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that define the results (must not change):
#   time-of-day buckets on an HHMM integer, inclusive bounds
#     Morning   500 .. 1159
#     Afternoon 1200 .. 1659
#     Evening   1700 .. 2059
#     Night     >= 2100 or <= 459   (values >= 2400 and negatives are Night)
#     anything else (460-499, 1160-1199, 1660-1699, 2060-2099, NULL) -> NULL
#   crime timestamp text format: "yyyy MMM dd hh:mm:ss a"
#   money text: "$52,806" -> strip every "$" and "," then parse as double
#   Earth radius for the great-circle distance: 6371.0 km
# ---------------------------------------------------------------------------
MORNING = (500, 1159)
AFTERNOON = (1200, 1659)
EVENING = (1700, 2059)
NIGHT_FROM = 2100
NIGHT_UNTIL = 459
PERIOD_NAMES = ("Morning", "Afternoon", "Evening", "Night")
CRIME_TS_FORMAT = "yyyy MMM dd hh:mm:ss a"
MONEY_STRIP_PATTERN = "[$,]"
EARTH_RADIUS_KM = 6371.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: Column | str) -> Column:
    """String -> int; malformed, empty or fractional text -> NULL (not an error)."""
    return _col(c).try_cast("int")


def to_long(c: Column | str) -> Column:
    return _col(c).try_cast("bigint")


def to_double(c: Column | str) -> Column:
    return _col(c).try_cast("double")


def time_of_day(hhmm: Column | str) -> Column:
    """Bucket an HHMM value (int, or text cast with ``try_cast``) into a day period."""
    t = to_int(hhmm)
    return (
        F.when(t.between(*MORNING), F.lit(PERIOD_NAMES[0]))
        .when(t.between(*AFTERNOON), F.lit(PERIOD_NAMES[1]))
        .when(t.between(*EVENING), F.lit(PERIOD_NAMES[2]))
        .when((t >= NIGHT_FROM) | (t <= NIGHT_UNTIL), F.lit(PERIOD_NAMES[3]))
    )


def parse_money(text: Column | str) -> Column:
    """``"$52,806"`` -> 52806.0; anything unparseable -> NULL."""
    stripped = F.trim(F.regexp_replace(_col(text), MONEY_STRIP_PATTERN, ""))
    return stripped.try_cast("double")


def parse_timestamp(text: Column | str, fmt: str = CRIME_TS_FORMAT) -> Column:
    """Parse text with a datetime pattern; unparseable text -> NULL."""
    return F.try_to_timestamp(_col(text), F.lit(fmt))


def format_timestamp(ts: Column | str, fmt: str = CRIME_TS_FORMAT) -> Column:
    return F.date_format(_col(ts), fmt)


def haversine_km(
    lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str
) -> Column:
    """Great-circle distance in km.

    ``1 - a`` is clamped at 0: rounding can push ``a`` a hair above 1 for antipodal
    points, and ``sqrt`` of a negative number would give NaN, which sorts after
    every real distance and would silently lose the argmin.
    """
    la1, lo1, la2, lo2 = (_col(c) for c in (lat1, lon1, lat2, lon2))
    dlat = F.radians(la2 - la1)
    dlon = F.radians(lo2 - lo1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    c = F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - a)))
    return F.lit(EARTH_RADIUS_KM) * F.lit(2.0) * c


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL text of :func:`haversine_km` over column names (same arithmetic, in doubles).

    For plans rebuilt in a loop: one expression string is parsed in a single call,
    where the Column form costs a round trip to the JVM per operator.
    """
    a = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return f"{EARTH_RADIUS_KM!r}D * 2.0D * atan2(sqrt({a}), sqrt(greatest(0.0D, 1.0D - ({a}))))"


def unit_vector(lat: Column | str, lon: Column | str) -> tuple[Column, Column, Column]:
    """(x, y, z) of a latitude/longitude on the unit sphere.

    The straight-line (chord) distance between unit vectors grows monotonically with
    the great-circle distance, so a 3-D grid over these coordinates gives exact
    nearest-neighbour blocking with no special cases at the poles or the date line.
    """
    phi = F.radians(_col(lat))
    lam = F.radians(_col(lon))
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def money_text(amount: Column | str) -> Column:
    """Render a number as ``$30,000`` (grouping commas, no decimals)."""
    return F.concat(F.lit("$"), F.format_number(_col(amount), 0))
