"""Feature queries (FE-1 .. FE-28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators.features import create_features
from ratelens.plans.common import Query, clean, features, rounded
from ratelens.plans.sql import over

_COLUMNS = [
    "load_id", "pickup", "delivery", "pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon", "distance",
    "equipment", "weight", "date", "market_index", "quote_signal", "posted_rate", "year", "month", "day",
    "day_of_week", "week_of_year", "day_of_year", "is_weekend", "is_month_start", "is_month_end", "route",
    "lat_diff", "lon_diff", "abs_lat_diff", "abs_lon_diff", "geo_distance", "log_distance", "distance_bucket",
    "log_weight", "weight_bucket", "weight_per_distance", "market_index_deviation", "quote_signal_deviation",
    "quote_signal_squared", "distance_x_weight", "distance_x_market", "distance_x_quote",
]
_EXACT = {
    "load_id", "pickup", "delivery", "equipment", "date", "year", "month", "day", "day_of_week", "day_of_year",
    "is_weekend", "is_month_start", "is_month_end", "route", "distance_bucket", "weight_bucket",
}


def _pick(*columns: str) -> Query:
    shown = ", ".join(c if c in _EXACT else f"round({c}, 6) AS {c}" for c in columns)
    return Query(
        lambda s, d: rounded(features(s, d).select(*columns), 6), over("features", f"SELECT {shown} FROM features")
    )


def _with_infinities(spark, folder):
    """Infinite inputs: they and everything computed from them become missing."""
    table = clean(spark, folder)
    endless = table.withColumns(
        {
            "distance": F.when(F.col("distance") == 3125, float("inf")).otherwise(F.col("distance")),
            "weight": F.when(F.col("weight") == 1000, float("-inf")).otherwise(F.col("weight")),
        }
    )
    columns = [
        "load_id", "distance", "log_distance", "distance_bucket", "weight", "log_weight", "weight_bucket",
        "weight_per_distance", "distance_x_weight",
    ]
    return rounded(create_features(endless).select(*columns), 6)


_INFINITIES_SQL = over(
    "features",
    """SELECT load_id, CASE WHEN far THEN NULL ELSE distance END AS distance,
    round(CASE WHEN far THEN NULL ELSE log_distance END, 6) AS log_distance, distance_bucket,
    CASE WHEN void THEN NULL ELSE weight END AS weight,
    round(CASE WHEN void THEN 0 ELSE log_weight END, 6) AS log_weight,
    CASE WHEN void THEN NULL ELSE weight_bucket END AS weight_bucket,
    round(CASE WHEN void THEN NULL WHEN far AND weight IS NOT NULL THEN 0
               ELSE weight_per_distance END, 6) AS weight_per_distance,
    round(CASE WHEN far OR void THEN NULL ELSE distance_x_weight END, 6) AS distance_x_weight
    FROM (SELECT *, coalesce(distance = 3125, false) AS far, coalesce(weight = 1000, false) AS void
          FROM features) x""",
)

QUERIES = {
    "fe1_10_calendar": _pick("load_id", "date", *_COLUMNS[14:23]),
    "fe11_route": _pick("load_id", "route"),
    "fe12_15_coordinate_differences": _pick("load_id", *_COLUMNS[24:28]),
    "fe16_geo_distance": _pick("load_id", "geo_distance"),
    "fe17_18_distance": _pick("load_id", "distance", "log_distance", "distance_bucket"),
    "fe19_21_weight": _pick("load_id", "weight", "log_weight", "weight_bucket", "weight_per_distance"),
    "fe22_24_market_and_quote": _pick("load_id", *_COLUMNS[34:37]),
    "fe25_27_interactions": _pick("load_id", *_COLUMNS[37:40]),
    "fe28_infinite_inputs": Query(_with_infinities, _INFINITIES_SQL),
    "fe_all_columns": _pick(*_COLUMNS),
}
