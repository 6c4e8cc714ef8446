"""Row-level column expressions shared by the operators.

All of them are built-in JVM expressions: nothing here leaves whole-stage codegen.
Missing values have one spelling, SQL ``NULL``; NaN and infinities become NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(column: Column) -> Column:
    """Remove leading and trailing Unicode whitespace; inner text and case are kept."""
    return F.btrim(column, F.lit(WHITESPACE))


def finite(column: Column) -> Column:
    """NaN and infinities become NULL (NaN sorts above infinity, so one test covers all)."""
    return F.when(F.abs(column) < INFINITY, column)


def not_nan(column: Column) -> Column:
    """Only NaN becomes NULL; infinities pass."""
    return F.when(~F.isnan(column), column)


def at_least(column: Column, low: float) -> Column:
    """Lower clip that keeps NULL (``greatest`` would return the bound instead)."""
    return F.when(column < low, F.lit(low)).otherwise(column)


def within(column: Column, low: float, high: float) -> Column:
    """Two-sided clip that keeps NULL."""
    return F.when(column < low, F.lit(low)).when(column > high, F.lit(high)).otherwise(column)


def as_day(column: Column, data_type: T.DataType, fmt: str | None = None) -> Column:
    """Calendar day of a text, timestamp or date column; unparseable text becomes NULL."""
    if isinstance(data_type, T.StringType):
        return F.try_to_date(column, fmt) if fmt else F.try_to_date(column)
    return column.cast("date")


def labelled_bucket(column: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed buckets: the first edge that is >= the value names the bucket.

    ``labels`` has one entry more than ``edges``. NULL, NaN and -infinity have no bucket;
    +infinity falls in the last one.
    """
    usable = column.isNotNull() & ~F.isnan(column) & (column > -INFINITY)
    out = F.when(~usable, F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(column <= edge, label)
    return out.otherwise(labels[-1])


def equal_width_bin(column: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based bin number over [low, high]; the last bin is closed on both sides.

    When every value is equal the range is widened by one half on each side, as
    histogram libraries do.
    """
    flat = low == high
    lo = F.when(flat, low - 0.5).otherwise(low)
    hi = F.when(flat, high + 0.5).otherwise(high)
    return F.least(F.width_bucket(column, lo, hi, F.lit(bins)), F.lit(bins).cast("bigint")) - 1


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine of the central angle between two points given in degrees.

    Keep it in a column of its own: ``arc_length`` reads it several times.
    """
    half_dlat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_dlon = (F.radians(lon2) - F.radians(lon1)) / 2
    return F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2
    )


def arc_length(hav: Column, radius: float) -> Column:
    """Great-circle distance for a haversine, which is first clipped to [0, 1]."""
    return 2 * radius * F.asin(F.sqrt(within(not_nan(hav), 0.0, 1.0)))


def route_label(pickup: Column, delivery: Column, missing_label: str = "nan") -> Column:
    """``pickup -> delivery``; a missing place is spelled with ``missing_label``."""
    return F.concat(
        F.coalesce(pickup, F.lit(missing_label)), F.lit(" -> "), F.coalesce(delivery, F.lit(missing_label))
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def finite_number(column: Column) -> Column:
    """Text or number -> finite double, or NULL when it is not one."""
    return finite(column.try_cast("double"))
