"""Exploratory group-bys, calendars, routes and top-k reports over a cleaned load table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import route_label, safe_ratio
from ratelens.functions.quantiles import group_table, hand_over, quantiles
from ratelens.sources.schemas import KEY, TARGET

# Weekday order and the columns of the highest-rate report.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TOP_LOAD_COLUMNS = [
    "load_id", "pickup", "delivery", "distance", "weight",
    "equipment", "market_index", "quote_signal", "posted_rate",
]


def _rows() -> Column:
    return F.count(F.lit(1))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``column, count`` of the non-null values, most frequent first, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(_rows().alias("count"))
    ordered = counts.orderBy(F.desc("count"), column)
    return ordered.limit(top) if top else ordered


def group_profile(df: DataFrame, key: str, target: str = TARGET, exact: bool = True) -> DataFrame:
    """Target count, mean, median and std per non-null ``key``, highest mean first."""
    t = F.col(target)
    out = quantiles(
        hand_over(df.select(key, target)),
        target,
        {"median": 0.5},
        by=[key],
        aggregates=[F.count(t).alias("count"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std")],
        exact=exact,
    )
    return out.select(key, "count", "mean", "median", "std").orderBy(F.desc_nulls_last("mean"), key)


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, missing`` for the named columns."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column", "missing")


def date_range(df: DataFrame, column: str = "date") -> DataFrame:
    """First and last day."""
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


def calendar_labels(df: DataFrame, column: str = "date") -> DataFrame:
    """Adds month, month abbreviation, weekday number (Monday 0) and weekday name."""
    day = F.col(column)
    return df.withColumns(
        {
            "month": F.month(day),
            "month_name": F.date_format(day, "MMM"),
            "day_of_week": F.weekday(day),
            "day_name": F.date_format(day, "EEEE"),
        }
    )


def monthly_profile(df: DataFrame, target: str = TARGET, column: str = "date") -> DataFrame:
    """``month, loads, mean_rate`` per calendar month, in month order."""
    dated = df.where(F.col(column).isNotNull())
    grouped = dated.groupBy(F.date_format(column, "yyyy-MM").alias("month"))
    return grouped.agg(_rows().alias("loads"), F.avg(target).alias("mean_rate")).orderBy("month")


def monthly_counts(df: DataFrame) -> DataFrame:
    """Rows per calendar month."""
    return monthly_profile(df).select("month", "loads")


def monthly_mean(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Mean target per calendar month."""
    return monthly_profile(df, target).select("month", "mean_rate")


def weekday_profile(df: DataFrame, target: str = TARGET, column: str = "date") -> DataFrame:
    """``day_name, loads, mean_rate`` for all seven days, Monday first; absent days are NULL."""
    stats = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.weekday(column).alias("weekday"))
        .agg(_rows().alias("loads"), F.avg(target).alias("mean_rate"))
    )
    week = df.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "weekday int, day_name string")
    return week.join(stats, "weekday", "left").orderBy("weekday").select("day_name", "loads", "mean_rate")


def with_route(df: DataFrame, missing_label: str = "nan") -> DataFrame:
    """Adds ``route``."""
    return df.withColumn("route", route_label(F.col("pickup"), F.col("delivery"), missing_label))


def route_profile(df: DataFrame, target: str = TARGET, exact: bool = True) -> DataFrame:
    """Target count, mean and median of every route, busiest first."""
    t = F.col(target)
    out = quantiles(
        hand_over(with_route(df).select("route", target)),
        target,
        {"median_rate": 0.5},
        by=["route"],
        aggregates=[F.count(t).alias("load_count"), F.avg(t).alias("mean_rate")],
        exact=exact,
    )
    return out.orderBy(F.desc("load_count"), "route")


def top_routes(df: DataFrame, top: int = 20, target: str = TARGET) -> DataFrame:
    """The busiest routes with mean and median target.

    Counts decide the ``top`` routes first; only their rows go through the median passes.
    """
    routed = hand_over(with_route(df).select("route", target))
    busiest = (
        routed.groupBy("route")
        .agg(F.count(target).alias("load_count"), F.avg(target).alias("mean_rate"))
        .orderBy(F.desc("load_count"), "route")
        .limit(top)
    )
    # ``top`` rows: a fixed bound, so broadcasting them is safe at any data size.
    busiest = group_table(busiest)
    chosen = routed.join(F.broadcast(busiest.select("route")), "route", "left_semi")
    medians = quantiles(chosen, target, {"median_rate": 0.5}, by=["route"], few_groups=True)
    return (
        busiest.join(F.broadcast(medians), "route", "left")
        .select("route", "load_count", "mean_rate", "median_rate")
        .orderBy(F.desc("load_count"), "route")
    )


def top_rate_routes(df: DataFrame, min_loads: int = 20, top: int = 15, target: str = TARGET) -> DataFrame:
    """Routes with at least ``min_loads`` rated loads, highest mean target first."""
    return (
        with_route(df)
        .groupBy("route")
        .agg(F.count(target).alias("load_count"), F.avg(target).alias("mean_rate"))
        .where(F.col("load_count") >= min_loads)
        .orderBy(F.desc("mean_rate"), "route")
        .limit(top)
    )


def top_loads(
    df: DataFrame, top: int = 10, target: str = TARGET, columns: Sequence[str] = TOP_LOAD_COLUMNS
) -> DataFrame:
    """The loads with the highest target; ties by key."""
    return df.select(*columns).orderBy(F.desc_nulls_last(target), KEY).limit(top)


def with_rate_per_mile(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Adds ``rate_per_mile`` for analysis only: it is derived from the target."""
    return df.withColumn("rate_per_mile", safe_ratio(F.col(target), F.col("distance")))
