"""Data-quality queries (DQ-1 .. DQ-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.functions.quantiles import hand_over
from ratelens.operators import quality as q
from ratelens.operators.cleaning import COORDINATE_RANGES, clean_loads
from ratelens.plans.common import Query, clean, features, rounded
from ratelens.plans.sql import over, union
from ratelens.sources.shipments import loads, loads_raw

_TEXT = ["load_id", "pickup", "delivery", "equipment", "date"]
_TYPES = {
    "load_id": "string", "pickup": "string", "delivery": "string", "pickup_lat": "double",
    "pickup_lon": "double", "delivery_lat": "double", "delivery_lon": "double", "distance": "double",
    "equipment": "string", "weight": "double", "date": "string", "market_index": "double",
    "quote_signal": "double", "posted_rate": "double",
}
_NUMERIC = [c for c, t in _TYPES.items() if t == "double"]


def planted_targets(df):
    """Loads whose target is missing without equipment and negative on the shortest hauls."""
    rate = F.when(F.col("distance") < 100, -F.col("posted_rate")).otherwise(F.col("posted_rate"))
    return df.withColumn("posted_rate", F.when(F.col("equipment").isNotNull(), rate))


def _quality_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS missing,
        round((count(*) - count({c})) * 100e0 / count(*), 2) AS "missing_%",
        count(DISTINCT {c}) AS "unique",
        count(*) - count(DISTINCT {c}) - CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END
          AS duplicate_values FROM loads_raw"""
        for c, t in _TYPES.items()
    ]
    return over("loads_raw", union(rows))


def describe_sql(source: str, columns: dict[str, str], digits: int = 6) -> str:
    """Describe rows for named expressions."""
    rows = [
        f"""SELECT '{name}' AS "column", count({e}) AS "count", round(avg({e}), {digits}) AS mean,
        round(stddev_samp({e}), {digits}) AS std, round(min({e}), {digits}) AS min,
        round(quantile_cont({e}, 0.25), {digits}) AS "25%", round(quantile_cont({e}, 0.5), {digits}) AS "50%",
        round(quantile_cont({e}, 0.75), {digits}) AS "75%", round(max({e}), {digits}) AS max FROM {source}"""
        for name, e in columns.items()
    ]
    return union(rows)


def _coordinates_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, min({c}) AS min, max({c}) AS max,
        count(*) FILTER (WHERE {c} NOT BETWEEN {low} AND {high}) AS out_of_range FROM loads"""
        for c, (low, high) in COORDINATE_RANGES.items()
    ]
    return over("loads", union(rows))


def _category_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM loads_raw) AS "unique",
        row_number() OVER (ORDER BY n DESC, value ASC NULLS LAST) AS rank, value, n
        FROM (SELECT {c} AS value, count(*) AS n FROM loads_raw GROUP BY 1) x"""
        for c in _TEXT
    ]
    return over(
        "loads_raw", 'SELECT "column", "unique", cast(rank AS INTEGER) AS rank, value, n FROM t WHERE rank <= 20',
        ("t", union(rows)),
    )


def _categorical_summary_sql() -> str:
    rows = [
        f"""SELECT '{c}' AS "column", cast(sum(n) AS BIGINT) AS "count", count(*) AS "unique",
        arg_min(value, struct_pack(m := -n, v := value)) AS top, max(n) AS freq
        FROM (SELECT {c} AS value, count(*) AS n FROM loads WHERE {c} IS NOT NULL GROUP BY 1) x"""
        for c in _TEXT
    ]
    return over("loads", union(rows))


def _final_sql() -> str:
    numeric_missing = [
        f"SELECT 'missing' AS section, '{c}' AS item, cast(count(*) - count({c}) AS DOUBLE) AS value FROM cleaned"
        for c in _TYPES
    ]
    target = describe_sql("cleaned", {"posted_rate": "posted_rate"})
    return over(
        "cleaned",
        """
SELECT 'shape' AS section, 'rows' AS item, cast(count(*) AS DOUBLE) AS value FROM cleaned
UNION ALL SELECT 'shape', 'columns', 14e0
UNION ALL SELECT 'duplicates', 'duplicate_rows',
  (SELECT cast(count(*) AS DOUBLE) FROM cleaned)
  - (SELECT cast(count(*) AS DOUBLE) FROM (SELECT DISTINCT * FROM cleaned) d)
UNION ALL SELECT 'duplicates', 'load_id', cast(count(*) - count(DISTINCT load_id) AS DOUBLE) FROM cleaned
UNION ALL SELECT section, item, value FROM m WHERE value > 0
UNION ALL SELECT 'target', item, value FROM
  (SELECT cast("count" AS DOUBLE) AS "count", mean, std, min, "25%", "50%", "75%", max FROM tgt) w
  UNPIVOT (value FOR item IN ("count", mean, std, min, "25%", "50%", "75%", max)) u""",
        ("m", union(numeric_missing)),
        ("tgt", target),
    )


def _feature_counts(spark, folder):
    """Columns a model may read and how often each is filled."""
    table = features(spark, folder)
    allowed = q.guard_features(table.columns)
    counted = table.agg(*[F.count(c).alias(c) for c in allowed])
    return counted.unpivot([], allowed, "column", "present")


def _feature_counts_sql() -> str:
    derived = [
        "year", "month", "day", "day_of_week", "week_of_year", "day_of_year", "is_weekend", "is_month_start",
        "is_month_end", "route", "lat_diff", "lon_diff", "abs_lat_diff", "abs_lon_diff", "geo_distance",
        "log_distance", "distance_bucket", "log_weight", "weight_bucket", "weight_per_distance",
        "market_index_deviation", "quote_signal_deviation", "quote_signal_squared", "distance_x_weight",
        "distance_x_market", "distance_x_quote",
    ]
    columns = [c for c in _TYPES if c != "posted_rate"] + derived
    return over(
        "features", union([f"""SELECT '{c}' AS "column", count({c}) AS present FROM features""" for c in columns])
    )


QUERIES = {
    "dq1_quality_report": Query(lambda s, d: q.quality_report(loads_raw(s, d)), _quality_sql()),
    "dq2_missing_report": Query(
        lambda s, d: q.missing_report(clean(s, d)),
        over(
            "clean",
            "SELECT * FROM m WHERE missing > 0",
            (
                "m",
                union([f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing FROM clean""" for c in _TYPES]),
            ),
        ),
    ),
    "dq3_duplicate_rows": Query(
        lambda s, d: q.duplicate_rows(loads_raw(s, d)),
        over(
            "loads_raw",
            """SELECT (SELECT count(*) FROM loads_raw)
            - (SELECT count(*) FROM (SELECT DISTINCT * FROM loads_raw) x) AS duplicate_rows""",
        ),
    ),
    "dq4_duplicate_keys": Query(
        lambda s, d: q.key_report(loads_raw(s, d)).select("duplicates"),
        over("loads_raw", "SELECT count(*) - count(DISTINCT load_id) AS duplicates FROM loads_raw"),
    ),
    "dq5_key_report": Query(
        lambda s, d: q.key_report(loads_raw(s, d), "equipment"),
        over(
            "loads_raw",
            """SELECT true AS key_present, count(*) - count(equipment) AS missing,
            count(*) - count(DISTINCT equipment) - CASE WHEN count(equipment) < count(*) THEN 1 ELSE 0 END
              AS duplicates FROM loads_raw""",
        ),
    ),
    "dq6_rule_violations": Query(
        lambda s, d: q.rule_violations(loads(s, d)),
        over(
            "loads",
            union(
                [
                    f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {c} {test} 0) AS violations FROM loads"
                    for name, c, test in q.ZERO_RULES
                ]
            ),
        ),
    ),
    "dq7_quote_range": Query(
        lambda s, d: rounded(q.value_range(loads(s, d)), 8),
        over("loads", "SELECT round(min(quote_signal), 8) AS min, round(max(quote_signal), 8) AS max FROM loads"),
    ),
    "dq8_coordinate_report": Query(lambda s, d: q.coordinate_report(loads(s, d)), _coordinates_sql()),
    "dq9_date_report": Query(
        lambda s, d: q.date_report(loads(s, d)),
        over(
            "loads",
            """SELECT 'date' AS "column", count(*) - count(date) AS original_missing,
            count(*) FILTER (WHERE date IS NOT NULL AND try_cast(date AS DATE) IS NULL) AS newly_invalid,
            count(*) - count(try_cast(date AS DATE)) AS final_missing,
            min(try_cast(date AS DATE)) AS min_date, max(try_cast(date AS DATE)) AS max_date FROM loads""",
        ),
    ),
    "dq10_category_report": Query(lambda s, d: q.category_report(loads_raw(s, d)), _category_sql()),
    "dq11_target_summary": Query(
        lambda s, d: rounded(q.target_summary(clean(s, d)), 6),
        over(
            "clean",
            """SELECT count(*) - count(posted_rate) AS missing, round(min(posted_rate), 6) AS min,
            round(max(posted_rate), 6) AS max, round(avg(posted_rate), 6) AS mean,
            round(median(posted_rate), 6) AS median,
            count(*) FILTER (WHERE posted_rate < 0) AS negative FROM clean""",
        ),
    ),
    "dq12_target_checks": Query(
        lambda s, d: q.check_target(clean(s, d)),
        over(
            "clean",
            """SELECT 'negative_target' AS rule, 'error' AS severity,
            count(*) FILTER (WHERE posted_rate < 0) AS violations,
            count(*) FILTER (WHERE posted_rate < 0) = 0 AS passed FROM clean
            UNION ALL SELECT 'missing_target', 'warning', count(*) - count(posted_rate),
            count(*) = count(posted_rate) FROM clean""",
        ),
    ),
    "dq12_planted_targets": Query(
        lambda s, d: q.check_target(planted_targets(clean(s, d))),
        over(
            "clean",
            """SELECT 'negative_target' AS rule, 'error' AS severity, count(*) FILTER (WHERE y < 0) AS violations,
            count(*) FILTER (WHERE y < 0) = 0 AS passed FROM planted
            UNION ALL SELECT 'missing_target', 'warning', count(*) - count(y), count(*) = count(y) FROM planted""",
            (
                "planted",
                """SELECT CASE WHEN equipment IS NULL THEN NULL WHEN distance < 100 THEN -posted_rate
                ELSE posted_rate END AS y FROM clean""",
            ),
        ),
    ),
    "dq13_numeric_summary": Query(
        lambda s, d: rounded(q.numeric_summary(loads(s, d)), 6),
        over("loads", describe_sql("loads", {c: c for c in _NUMERIC})),
    ),
    "dq14_categorical_summary": Query(lambda s, d: q.categorical_summary(loads(s, d)), _categorical_summary_sql()),
    "dq15_final_report": Query(
        lambda s, d: rounded(q.final_report(hand_over(clean_loads(loads_raw(s, d))), kept=True), 6), _final_sql()
    ),
    "dq16_shape": Query(
        lambda s, d: q.shape_report(loads_raw(s, d)),
        over("loads_raw", "SELECT count(*) AS rows, cast(14 AS BIGINT) AS columns FROM loads_raw"),
    ),
    "dq16_head": Query(
        lambda s, d: rounded(q.head(loads_raw(s, d), order_by=["load_id", "pickup"]), 6),
        over(
            "loads_raw",
            f"""SELECT {", ".join(f"round({c}, 6) AS {c}" if t == "double" else c for c, t in _TYPES.items())}
            FROM loads_raw ORDER BY load_id, pickup LIMIT 5""",
        ),
    ),
    "dq17_feature_columns": Query(_feature_counts, _feature_counts_sql()),
}
