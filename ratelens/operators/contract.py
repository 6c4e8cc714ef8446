"""Contract checks on published tables.

A check returns one row per rule (``position, rule, violations, passed, message``) from one
or two aggregations; ``assert_contract`` raises on the first failed rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.errors import ContractError
from ratelens.functions.columns import as_day, finite_number
from ratelens.sources.schemas import KEY, PREDICTION, PREDICTION_COLUMNS, SCENARIO_COLUMNS

# Size and key format of the published prediction table.
EXPECTED_ROWS = 12_000
KEY_FORMAT = "TE-%06d"

# Tolerances of the closeness test.
RELATIVE_TOLERANCE = 1e-5
ABSOLUTE_TOLERANCE = 1e-8


@dataclass(frozen=True)
class Lane:
    """Constants every scenario row must carry, and its period (both days included)."""

    # The published lane.
    pickup: str = "Lexington"
    delivery: str = "Fort Wayne"
    distance: float = 360.0
    equipment: str = "Dry Van"
    weight: float = 32_000.0
    start: date = date(2025, 12, 1)
    end: date = date(2025, 12, 31)


def expected_keys(spark: SparkSession, rows: int = EXPECTED_ROWS, fmt: str = KEY_FORMAT) -> DataFrame:
    """``load_id`` 1..rows in the published format, generated in parallel."""
    return spark.range(1, rows + 1).select(F.format_string(fmt, "id").alias(KEY))


def is_close(value: Column, constant: float) -> Column:
    """abs(a - b) <= 1e-8 + 1e-5 * abs(b)."""
    return F.abs(value - constant) <= ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * abs(constant)


def _rule_rows(wide: DataFrame) -> DataFrame:
    counts = wide.select(*[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in wide.columns])
    return counts.unpivot([], counts.columns, "rule", "violations")


def _column_rule(df: DataFrame, rule: str, expected: Sequence[str]) -> DataFrame:
    wrong = int(df.columns != list(expected))
    return df.sparkSession.createDataFrame([(rule, wrong)], "rule string, violations bigint")


def _finish(rules: DataFrame, messages: dict[str, str]) -> DataFrame:
    order = [(i, name, text) for i, (name, text) in enumerate(messages.items(), 1)]
    known = rules.sparkSession.createDataFrame(order, "position int, rule string, message string")
    return (
        known.join(rules, "rule", "left")
        # A rule without a count is not passed: it was not looked at.
        .select("position", "rule", "violations", F.coalesce(F.col("violations") == 0, F.lit(False)).alias("passed"), "message")
        .orderBy("position")
    )


def check_predictions(
    df: DataFrame, expected: DataFrame, rows: int = EXPECTED_ROWS, key: str = KEY
) -> DataFrame:
    """Prediction table rules: columns, size, keys, key set, finite and positive predictions.

    Keys are combined before the full outer join with ``expected`` (distinct keys), so one
    repeated key cannot load a single task.
    """
    messages = {
        "columns": f"columns must be exactly {PREDICTION_COLUMNS}, in this order",
        "row_count": f"there must be exactly {rows} rows",
        "missing_keys": "keys must not be missing",
        "duplicate_keys": "keys must be unique",
        "keys_not_submitted": "every expected key must be present",
        "keys_not_expected": "only expected keys may be present",
        "not_finite": "predictions must be finite numbers",
        "not_positive": "predictions must be positive",
    }
    columns = _column_rule(df, "columns", PREDICTION_COLUMNS)
    number = finite_number(F.col(PREDICTION))
    values = df.agg(
        F.abs(F.count(F.lit(1)) - rows).alias("row_count"),
        F.count_if(number.isNull()).alias("not_finite"),
        F.count_if(number <= 0).alias("not_positive"),
    )
    submitted = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    wanted = expected.select(F.col(key).alias("__want"))
    matched = submitted.join(wanted, F.col("__key") == F.col("__want"), "full")
    n = F.col("__n")
    keys = matched.agg(
        F.sum(F.when(F.col("__key").isNull() & n.isNotNull(), n)).alias("missing_keys"),
        F.sum(F.when(F.col("__key").isNotNull(), n - 1)).alias("duplicate_keys"),
        F.count_if(n.isNull()).alias("keys_not_submitted"),
        F.count_if(F.col("__want").isNull() & F.col("__key").isNotNull()).alias("keys_not_expected"),
    )
    rules = columns.unionByName(_rule_rows(values)).unionByName(_rule_rows(keys))
    return _finish(rules, messages)


def check_scenario(df: DataFrame, lane: Lane = Lane(), date_format: str | None = None) -> DataFrame:
    """Scenario table rules: columns, dates, finite numbers, full calendar, constants, positivity."""
    days = (lane.end - lane.start).days + 1
    messages = {
        "columns": f"columns must be exactly {SCENARIO_COLUMNS}, in this order",
        "invalid_dates": "dates must parse",
        "distance_not_finite": "distance must be a finite number",
        "weight_not_finite": "weight must be a finite number",
        "prediction_not_finite": "predictions must be finite numbers",
        "duplicate_dates": "dates must be unique",
        "row_count": f"there must be exactly {days} rows",
        "days_missing": f"every day from {lane.start} to {lane.end} must be present",
        "days_extra": f"only days from {lane.start} to {lane.end} may be present",
        "pickup": f"pickup must be {lane.pickup}",
        "delivery": f"delivery must be {lane.delivery}",
        "distance": f"distance must be {lane.distance:g}",
        "equipment": f"equipment must be {lane.equipment}",
        "weight": f"weight must be {lane.weight:g}",
        "not_positive": "predictions must be positive",
    }
    day = as_day(F.col("date"), df.schema["date"].dataType, date_format)
    distance, weight = finite_number(F.col("distance")), finite_number(F.col("weight"))
    number = finite_number(F.col(PREDICTION))

    def broken(test: Column) -> Column:
        return F.count_if(~F.coalesce(test, F.lit(False)))

    values = df.agg(
        F.count_if(day.isNull()).alias("invalid_dates"),
        F.count_if(distance.isNull()).alias("distance_not_finite"),
        F.count_if(weight.isNull()).alias("weight_not_finite"),
        F.count_if(number.isNull()).alias("prediction_not_finite"),
        F.abs(F.count(F.lit(1)) - days).alias("row_count"),
        broken(F.col("pickup") == lane.pickup).alias("pickup"),
        broken(F.col("delivery") == lane.delivery).alias("delivery"),
        broken(is_close(distance, lane.distance)).alias("distance"),
        broken(F.col("equipment") == lane.equipment).alias("equipment"),
        broken(is_close(weight, lane.weight)).alias("weight"),
        F.count_if(number <= 0).alias("not_positive"),
    )
    per_day = df.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    inside = F.col("__day").between(F.lit(lane.start), F.lit(lane.end))
    calendar = per_day.agg(
        F.sum(F.when(F.col("__day").isNotNull(), F.col("__n") - 1)).alias("duplicate_dates"),
        (F.lit(days) - F.count_if(inside)).alias("days_missing"),
        F.count_if(~inside).alias("days_extra"),
    )
    columns = _column_rule(df, "columns", SCENARIO_COLUMNS)
    rules = columns.unionByName(_rule_rows(values)).unionByName(_rule_rows(calendar))
    return _finish(rules, messages)


def assert_contract(report: DataFrame) -> None:
    """Raise ``ContractError`` for the first failed rule."""
    failed = report.where(~F.col("passed")).orderBy("position").limit(1).collect()
    if failed:
        raise ContractError(f"{failed[0]['message']} ({failed[0]['violations']} violations)")
