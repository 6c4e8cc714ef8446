"""The 26 derived columns of a load: projections only, no shuffle.

The target is never read. Missing inputs give missing outputs (imputation belongs to the
model), except the three calendar flags, which are 0 without a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.functions.columns import (
    arc_length,
    as_day,
    at_least,
    finite,
    haversine,
    labelled_bucket,
    not_nan,
    route_label,
    safe_ratio,
)

# Fixed values.
EARTH_RADIUS_MILES = 3958.8
MARKET_CENTRE = 1.0
QUOTE_CENTRE = 2.0
DISTANCE_EDGES = [250, 500, 1000, 1500, 2500]
DISTANCE_LABELS = ["very_short", "short", "medium", "long", "very_long", "extreme"]
WEIGHT_EDGES = [10000, 20000, 30000, 40000]
WEIGHT_LABELS = ["very_light", "light", "medium", "heavy", "very_heavy"]


def calendar_columns(day: Column) -> dict[str, Column]:
    """Date parts; Monday is day 0 and weeks are ISO weeks."""

    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("int"), F.lit(0))

    return {
        "year": F.year(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "day_of_week": F.weekday(day),
        "week_of_year": F.weekofyear(day).cast("double"),
        "day_of_year": F.dayofyear(day),
        "is_weekend": flag(F.weekday(day) >= 5),
        "is_month_start": flag(F.dayofmonth(day) == 1),
        "is_month_end": flag(day == F.last_day(day)),
    }


def geography_columns(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, hav: Column
) -> dict[str, Column]:
    """Coordinate differences (delivery minus pickup) and great-circle distance."""
    return {
        "lat_diff": finite(lat2 - lat1),
        "lon_diff": finite(lon2 - lon1),
        "abs_lat_diff": finite(F.abs(lat2 - lat1)),
        "abs_lon_diff": finite(F.abs(lon2 - lon1)),
        "geo_distance": arc_length(hav, EARTH_RADIUS_MILES),
    }


def size_columns(distance: Column, weight: Column) -> dict[str, Column]:
    """Logarithms, buckets and density of distance and weight."""
    return {
        "log_distance": F.log1p(finite(at_least(distance, 0.0))),
        "distance_bucket": labelled_bucket(distance, DISTANCE_EDGES, DISTANCE_LABELS),
        "log_weight": F.log1p(finite(at_least(weight, 0.0))),
        "weight_bucket": labelled_bucket(weight, WEIGHT_EDGES, WEIGHT_LABELS),
        "weight_per_distance": finite(safe_ratio(weight, distance)),
    }


def market_columns(distance: Column, weight: Column, market: Column, quote: Column) -> dict[str, Column]:
    """Deviations from the neutral market and quote, and interactions with distance."""
    return {
        "market_index_deviation": finite(market - MARKET_CENTRE),
        "quote_signal_deviation": finite(quote - QUOTE_CENTRE),
        "quote_signal_squared": finite(quote * quote),
        "distance_x_weight": finite(distance * weight),
        "distance_x_market": finite(distance * market),
        "distance_x_quote": finite(distance * quote),
    }


def create_features(df: DataFrame, missing_label: str = "nan") -> DataFrame:
    """Input columns (date as a day, doubles finite) followed by the 26 derived columns.

    Values that several columns read (the day, the inputs without NaN, the haversine) are
    projected first, so each is computed once per row.
    """
    places = ("pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon")
    inputs = (*places, "distance", "weight", "market_index", "quote_signal")
    numbers = {f"__{name}": not_nan(F.col(name).cast("double")) for name in inputs}
    base = df.withColumns({"date": as_day(F.col("date"), df.schema["date"].dataType), **numbers})
    at = [F.col(f"__{name}") for name in places]
    base = base.withColumn("__haversine", haversine(*at))

    def kept(field: T.StructField) -> Column:
        floating = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        return (finite(F.col(field.name)) if floating else F.col(field.name)).alias(field.name)

    distance, weight, market, quote = (F.col(f"__{name}") for name in inputs[4:])
    derived = {
        **calendar_columns(F.col("date")),
        "route": route_label(F.col("pickup"), F.col("delivery"), missing_label),
        **geography_columns(*at, F.col("__haversine")),
        **size_columns(distance, weight),
        **market_columns(distance, weight, market, quote),
    }
    return base.select(*map(kept, df.schema), *[expr.alias(name) for name, expr in derived.items()])
