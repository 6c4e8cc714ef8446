"""Exploration queries (EX-1 .. EX-30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators import distribution as dist
from ratelens.operators import explore as x
from ratelens.plans.common import NUMERIC_INPUTS, Query, clean, rounded, rounded_mean, rounded_mean_sql
from ratelens.plans.quality import describe_sql
from ratelens.plans.sql import over, union

_PROFILED = ["posted_rate", *NUMERIC_INPUTS, "rate_per_mile"]
_RPM = "posted_rate / nullif(distance, 0)"
_NUMERIC = [
    "pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon", "distance", "weight", "market_index",
    "quote_signal", "posted_rate",
]


def _raised(df):
    """Loads without equipment at twenty times their rate."""
    return df.withColumn("posted_rate", F.when(F.col("equipment").isNull(), F.col("posted_rate") * 20).otherwise(F.col("posted_rate")))


def _histogram_sql(columns: dict[str, str], bins: int) -> str:
    rows = [
        f"""SELECT '{name}' AS "column", cast(b.bin AS BIGINT) AS bin,
        round(lo + (hi - lo) / {bins} * b.bin, 6) AS "left",
        round(lo + (hi - lo) / {bins} * (b.bin + 1), 6) AS "right",
        count(v) AS "count"
        FROM (SELECT unnest(range(0, {bins})) AS bin) b
        CROSS JOIN (SELECT min({e}) AS lo, max({e}) AS hi FROM clean) m
        LEFT JOIN (SELECT {e} AS v FROM clean) c
          ON b.bin = least(floor({bins}e0 * (c.v - m.lo) / (m.hi - m.lo)), {bins - 1})
        GROUP BY 1, 2, 3, 4"""
        for name, e in columns.items()
    ]
    return over("clean", union(rows))


def _density_sql(columns: dict[str, str]) -> str:
    rows = [
        f"""SELECT '{name}' AS "column", cast(g.i AS INTEGER) AS point,
        round(lo + (hi - lo) / 199 * g.i, 6) AS x,
        round(sum(w * exp(-0.5 * pow((lo + (hi - lo) / 199 * g.i - v) / h, 2)))
              / (n * h * sqrt(2 * pi())), 10) AS density
        FROM (SELECT {e} AS v, count(*) AS w FROM clean WHERE {e} IS NOT NULL GROUP BY 1) c
        CROSS JOIN (SELECT min({e}) AS lo, max({e}) AS hi, count({e}) AS n,
                    stddev_samp({e}) * pow(count({e}), -0.2) AS h FROM clean) m
        CROSS JOIN (SELECT unnest(range(0, 200)) AS i) g
        GROUP BY g.i, lo, hi, n, h"""
        for name, e in columns.items()
    ]
    return over("clean", union(rows))


def _box_sql(by: str | None) -> str:
    key = f"{by}, " if by else ""
    group = f"WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""
    on = f"c.{by} = q.{by}" if by else "true"
    return over(
        "clean",
        f"""SELECT {f'q.{by}, ' if by else ''}round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(min(c.posted_rate) FILTER (WHERE c.posted_rate >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
        round(max(c.posted_rate) FILTER (WHERE c.posted_rate <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
        count(*) FILTER (WHERE c.posted_rate < q1 - 1.5 * (q3 - q1) OR c.posted_rate > q3 + 1.5 * (q3 - q1))
          AS outliers
        FROM clean c JOIN (SELECT {key}quantile_cont(posted_rate, 0.25) AS q1,
          quantile_cont(posted_rate, 0.5) AS median, quantile_cont(posted_rate, 0.75) AS q3
          FROM clean {group}) q ON {on}
        GROUP BY {f'q.{by}, ' if by else ''}q1, median, q3""",
    )


def _grid_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column",
        cast(least(floor(50e0 * ({c} - x_lo) / (x_hi - x_lo)), 49) AS BIGINT) AS x_bin,
        cast(least(floor(50e0 * (posted_rate - y_lo) / (y_hi - y_lo)), 49) AS BIGINT) AS y_bin,
        count(*) AS "count"
        FROM clean CROSS JOIN (SELECT min({c}) AS x_lo, max({c}) AS x_hi, min(posted_rate) AS y_lo,
          max(posted_rate) AS y_hi FROM clean WHERE {c} IS NOT NULL AND posted_rate IS NOT NULL) m
        WHERE {c} IS NOT NULL AND posted_rate IS NOT NULL GROUP BY 2, 3"""
        for c in NUMERIC_INPUTS
    ]
    return over("clean", union(rows))


def _matrix_sql() -> str:
    rows = [
        f"""SELECT '{a}' AS "column", '{b}' AS other, round(corr({a}, {b}), 6) AS correlation FROM clean"""
        for a in _NUMERIC
        for b in _NUMERIC
    ]
    return over("clean", union(rows))


def _target_corr_sql(with_self: bool) -> str:
    columns = [c for c in _NUMERIC if with_self or c != "posted_rate"]
    rows = [
        f"""SELECT '{c}' AS "column", round(corr({c}, posted_rate), 6) AS correlation FROM clean""" for c in columns
    ]
    return over("clean", union(rows))


def _top_sql(column: str) -> str:
    return over(
        "clean",
        f"""SELECT {column}, count(*) AS "count" FROM clean WHERE {column} IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
    )


_ROUTE = "concat(coalesce(pickup, 'nan'), ' -> ', coalesce(delivery, 'nan'))"
_MEAN = rounded_mean_sql("avg(posted_rate)")
_ROUTES = f"""SELECT {_ROUTE} AS route, count(posted_rate) AS load_count,
 {_MEAN} AS mean_rate, round(median(posted_rate), 6) AS median_rate
 FROM clean GROUP BY 1 ORDER BY load_count DESC, route"""


def _weekday_sql(measure: str) -> str:
    return over(
        "clean",
        f"""SELECT w.day_name, {measure} FROM (VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'),
        ('Friday'), ('Saturday'), ('Sunday')) w(day_name)
        LEFT JOIN (SELECT dayname(date) AS day_name, count(*) AS loads, avg(posted_rate) AS mean_rate
          FROM clean WHERE date IS NOT NULL GROUP BY 1) c ON c.day_name = w.day_name""",
    )


def _outlier_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", round(q1, 8) AS q1, round(q3, 8) AS q3, round(q3 - q1, 8) AS iqr,
        round(q1 - 1.5 * (q3 - q1), 8) AS lower, round(q3 + 1.5 * (q3 - q1), 8) AS upper,
        count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
        round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))
              * 100e0 / count({c}), 8) AS outlier_pct
        FROM clean CROSS JOIN (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM clean) q
        GROUP BY q1, q3"""
        for c in [*NUMERIC_INPUTS, "posted_rate"]
    ]
    return over("clean", union(rows))


def _log_histogram(spark, folder):
    table = clean(spark, folder).withColumn("log_rate", F.log1p("posted_rate"))
    return rounded(dist.histogram(table, ["log_rate"], 60), 6)


QUERIES = {
    "ex1_describe": Query(
        lambda s, d: rounded(dist.describe(x.with_rate_per_mile(clean(s, d)), _PROFILED), 6),
        over("clean", describe_sql("clean", {c: _RPM if c == "rate_per_mile" else c for c in _PROFILED})),
    ),
    "ex2_3_moments": Query(
        lambda s, d: rounded(dist.moments(clean(s, d), "posted_rate"), 6),
        over(
            "clean",
            """SELECT round(skewness(posted_rate), 6) AS skewness, round(kurtosis(posted_rate), 6) AS kurtosis
            FROM clean""",
        ),
    ),
    "ex4_histogram_60": Query(
        lambda s, d: rounded(
            dist.histogram(x.with_rate_per_mile(clean(s, d)), ["posted_rate", "distance", "rate_per_mile"], 60), 6
        ),
        _histogram_sql({"posted_rate": "posted_rate", "distance": "distance", "rate_per_mile": _RPM}, 60),
    ),
    "ex5_histogram_50": Query(
        lambda s, d: rounded(dist.histogram(clean(s, d), NUMERIC_INPUTS, 50), 6),
        _histogram_sql({c: c for c in NUMERIC_INPUTS}, 50),
    ),
    "ex6_log_histogram": Query(_log_histogram, _histogram_sql({"log_rate": "ln(1 + posted_rate)"}, 60)),
    "ex7_density_curve": Query(
        lambda s, d: rounded(
            rounded(dist.density_curve(clean(s, d), ["posted_rate", *NUMERIC_INPUTS]), 10).withColumn(
                "x", F.round("x", 6)
            ),
            10,
        ),
        _density_sql({c: c for c in ["posted_rate", *NUMERIC_INPUTS]}),
    ),
    "ex8_box": Query(lambda s, d: rounded(dist.box_stats(clean(s, d), "posted_rate"), 6), _box_sql(None)),
    "ex9_box_by_equipment": Query(
        lambda s, d: rounded(dist.box_stats(clean(s, d), "posted_rate", "equipment"), 6), _box_sql("equipment")
    ),
    "ex10_density_grid": Query(
        lambda s, d: dist.density_grid(clean(s, d), NUMERIC_INPUTS, "posted_rate"), _grid_sql()
    ),
    "ex11_correlation_matrix": Query(
        lambda s, d: rounded(dist.correlation_matrix(clean(s, d), _NUMERIC), 6), _matrix_sql()
    ),
    "ex12_target_correlations": Query(
        lambda s, d: rounded(dist.target_correlations(clean(s, d), _NUMERIC, "posted_rate"), 6),
        _target_corr_sql(True),
    ),
    "ex12_feature_correlations": Query(
        lambda s, d: rounded(dist.target_correlations(clean(s, d), _NUMERIC, "posted_rate", False), 6),
        _target_corr_sql(False),
    ),
    "ex13_equipment_counts": Query(
        lambda s, d: x.value_counts(clean(s, d), "equipment"),
        over(
            "clean",
            """SELECT equipment, count(*) AS "count" FROM clean WHERE equipment IS NOT NULL
            GROUP BY 1 ORDER BY 2 DESC, 1""",
        ),
    ),
    "ex14_equipment_profile": Query(
        lambda s, d: rounded(rounded_mean(x.group_profile(clean(s, d), "equipment"), "mean"), 6),
        over(
            "clean",
            f"""SELECT equipment, count(posted_rate) AS "count", {_MEAN} AS mean,
            round(median(posted_rate), 6) AS median, round(stddev_samp(posted_rate), 6) AS std
            FROM clean WHERE equipment IS NOT NULL GROUP BY 1""",
        ),
    ),
    "ex15_top_pickups": Query(lambda s, d: x.value_counts(clean(s, d), "pickup", 15), _top_sql("pickup")),
    "ex16_top_deliveries": Query(lambda s, d: x.value_counts(clean(s, d), "delivery", 15), _top_sql("delivery")),
    "ex17_distance_quantiles": Query(
        lambda s, d: rounded(dist.column_quantiles(clean(s, d), "distance"), 6),
        over(
            "clean",
            union(
                [
                    f"SELECT '{n}' AS quantile, round(quantile_cont(distance, {p}), 6) AS value FROM clean"
                    for n, p in dist.DISTANCE_QUANTILES.items()
                ]
            ),
        ),
    ),
    "ex18_missing_counts": Query(
        lambda s, d: x.missing_counts(clean(s, d), ["weight", "market_index"]),
        over(
            "clean",
            union(
                [
                    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM clean"""
                    for c in ("weight", "market_index")
                ]
            ),
        ),
    ),
    "ex19_date_range": Query(
        lambda s, d: x.date_range(clean(s, d)),
        over("clean", "SELECT min(date) AS min_date, max(date) AS max_date FROM clean"),
    ),
    "ex20_calendar_labels": Query(
        lambda s, d: x.calendar_labels(clean(s, d)).select(
            "load_id", "date", "month", "month_name", "day_of_week", "day_name"
        ),
        over(
            "clean",
            """SELECT load_id, date, cast(month(date) AS INTEGER) AS month, strftime(date, '%b') AS month_name,
            cast(isodow(date) - 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name FROM clean""",
        ),
    ),
    "ex21_monthly_counts": Query(
        lambda s, d: x.monthly_counts(clean(s, d)),
        over(
            "clean",
            """SELECT strftime(date, '%Y-%m') AS month, count(*) AS loads FROM clean
            WHERE date IS NOT NULL GROUP BY 1""",
        ),
    ),
    "ex22_monthly_mean": Query(
        lambda s, d: rounded_mean(x.monthly_mean(clean(s, d)), "mean_rate"),
        over(
            "clean",
            f"""SELECT strftime(date, '%Y-%m') AS month, {_MEAN} AS mean_rate FROM clean
            WHERE date IS NOT NULL GROUP BY 1""",
        ),
    ),
    "ex23_weekday_counts": Query(
        lambda s, d: x.weekday_profile(clean(s, d)).select("day_name", "loads"), _weekday_sql("loads")
    ),
    "ex24_weekday_mean": Query(
        lambda s, d: rounded_mean(x.weekday_profile(clean(s, d)).select("day_name", "mean_rate"), "mean_rate"),
        _weekday_sql(rounded_mean_sql("mean_rate") + " AS mean_rate"),
    ),
    "ex25_outlier_summary": Query(
        lambda s, d: rounded(dist.outlier_summary(clean(s, d), [*NUMERIC_INPUTS, "posted_rate"]), 8),
        _outlier_sql(),
    ),
    "ex26_planted_outliers": Query(
        lambda s, d: rounded(dist.above_upper_fence(_raised(clean(s, d)), "posted_rate").select("load_id", "posted_rate"), 6),
        over(
            "clean",
            """SELECT load_id, round(y, 6) AS posted_rate FROM planted WHERE y >
            (SELECT quantile_cont(y, 0.75) + 1.5 * (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) FROM planted)""",
            ("planted", "SELECT load_id, CASE WHEN equipment IS NULL THEN posted_rate * 20 ELSE posted_rate END AS y FROM clean"),
        ),
    ),
    "ex26_above_upper_fence": Query(
        lambda s, d: rounded(dist.above_upper_fence(clean(s, d), "posted_rate").select("load_id", "posted_rate"), 6),
        over(
            "clean",
            """SELECT load_id, round(posted_rate, 6) AS posted_rate FROM clean WHERE posted_rate >
            (SELECT quantile_cont(posted_rate, 0.75) + 1.5 *
             (quantile_cont(posted_rate, 0.75) - quantile_cont(posted_rate, 0.25)) FROM clean)""",
        ),
    ),
    "ex27_top_loads": Query(
        lambda s, d: rounded(x.top_loads(clean(s, d)), 6),
        over(
            "clean",
            """SELECT load_id, pickup, delivery, distance, weight, equipment, round(market_index, 6) AS market_index,
            round(quote_signal, 6) AS quote_signal, round(posted_rate, 6) AS posted_rate
            FROM clean ORDER BY clean.posted_rate DESC NULLS LAST, load_id LIMIT 10""",
        ),
    ),
    "ex28_top_routes": Query(
        lambda s, d: rounded(rounded_mean(x.top_routes(clean(s, d), 20), "mean_rate"), 6), over("clean", _ROUTES + " LIMIT 20")
    ),
    "ex28_route_profile": Query(
        lambda s, d: rounded(rounded_mean(x.route_profile(clean(s, d)), "mean_rate"), 6), over("clean", _ROUTES)),
    "ex29_top_rate_routes": Query(
        lambda s, d: rounded_mean(x.top_rate_routes(clean(s, d)), "mean_rate"),
        over(
            "clean",
            f"""SELECT route, load_count, {rounded_mean_sql("mean_rate")} AS mean_rate FROM
            (SELECT {_ROUTE} AS route, count(posted_rate) AS load_count, avg(posted_rate) AS mean_rate
             FROM clean GROUP BY 1 HAVING count(posted_rate) >= 20) r
            ORDER BY r.mean_rate DESC, route LIMIT 15""",
        ),
    ),
    "ex30_rate_per_mile": Query(
        lambda s, d: rounded(x.with_rate_per_mile(clean(s, d)).select("load_id", "rate_per_mile"), 9),
        over("clean", f"SELECT load_id, round({_RPM}, 9) AS rate_per_mile FROM clean"),
    ),
}
