"""Prediction floor, regression metrics and the report tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import at_least
from ratelens.sources.schemas import KEY, PREDICTION, TARGET

# Fixed value: the smallest rate ever published.
RATE_FLOOR = 0.01


def floor_predictions(df: DataFrame, prediction: str = PREDICTION, floor: float = RATE_FLOOR) -> DataFrame:
    """Raise predictions below the floor to it; missing predictions stay missing."""
    return df.withColumn(prediction, at_least(F.col(prediction), floor))


def mean_absolute_error(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def root_mean_squared_error(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def r_squared(y: Column, p: Column) -> Column:
    """1 - SSE / SST around the mean of the scored rows; NULL below two rows.

    Without any spread in ``y`` it is 1 for a perfect prediction and 0 otherwise.
    """
    y = F.when(p.isNotNull(), y)
    error = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    flat = F.when(error == 0, 1.0).otherwise(0.0)
    return F.when(F.count(y) > 1, F.when(spread == 0, flat).otherwise(1 - error / F.nullif(spread, F.lit(0.0))))


def metric_columns(y: Column, p: Column) -> list[Column]:
    """MAE, RMSE and R2 as aggregates of one pass."""
    return [
        mean_absolute_error(y, p).alias("MAE"),
        root_mean_squared_error(y, p).alias("RMSE"),
        r_squared(y, p).alias("R2"),
    ]


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), target: str = TARGET, prediction: str = PREDICTION
) -> DataFrame:
    """``by..., MAE, RMSE, R2`` in one grouped aggregation."""
    return df.groupBy(*by).agg(*metric_columns(F.col(target), F.col(prediction)))


def fold_report(
    scored: DataFrame, target: str = TARGET, prediction: str = PREDICTION, column: str = "date"
) -> DataFrame:
    """Date ranges, row counts and validation metrics per fold.

    ``scored`` has ``fold``, ``role`` and, for validation rows, a prediction. Everything is
    one grouped aggregation with conditional inputs; no pivot and no join.
    """
    train, valid = F.col("role") == "train", F.col("role") == "valid"
    day = F.col(column)
    y, p = F.when(valid, F.col(target)), F.when(valid, F.col(prediction))
    return scored.groupBy("fold").agg(
        F.min(F.when(train, day)).alias("train_start"),
        F.max(F.when(train, day)).alias("train_end"),
        F.min(F.when(valid, day)).alias("validation_start"),
        F.max(F.when(valid, day)).alias("validation_end"),
        F.count_if(train).alias("train_rows"),
        F.count_if(valid).alias("validation_rows"),
        *metric_columns(y, p),
    )


def fold_summary(results: DataFrame) -> DataFrame:
    """Mean of the metrics over folds and sample std of MAE and RMSE."""
    return results.agg(
        F.avg("MAE").alias("mean_MAE"),
        F.avg("RMSE").alias("mean_RMSE"),
        F.avg("R2").alias("mean_R2"),
        F.stddev_samp("MAE").alias("std_MAE"),
        F.stddev_samp("RMSE").alias("std_RMSE"),
    )


def tuning_summary(results: DataFrame) -> DataFrame:
    """Mean and std of the metrics per configuration, lowest mean MAE first."""
    return (
        results.groupBy("configuration")
        .agg(
            F.avg("MAE").alias("mean_MAE"),
            F.avg("RMSE").alias("mean_RMSE"),
            F.avg("R2").alias("mean_R2"),
            F.stddev_samp("MAE").alias("std_MAE"),
            F.stddev_samp("RMSE").alias("std_RMSE"),
        )
        .orderBy(F.asc_nulls_last("mean_MAE"), "configuration")
    )


def prediction_summary(df: DataFrame, prediction: str = PREDICTION, key: str | None = KEY) -> DataFrame:
    """Rows, missing predictions, repeated keys, min, max and mean prediction.

    With a key, rows are first combined per key, so repeats are counted without a
    distinct-aggregate expansion; without one (scenario tables) it is a plain aggregate.
    """
    p = F.col(prediction)
    facts = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(p.isNull()).alias("missing"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        F.sum(p).alias("total"),
        F.count(p).alias("present"),
    ]
    mean = (F.col("total") / F.nullif(F.col("present"), F.lit(0).cast("bigint"))).alias("mean")
    if key is None or key not in df.columns:
        return df.agg(*facts).select("rows", "missing", "min", "max", mean)
    per_key = df.groupBy(key).agg(*facts)
    return per_key.agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        (F.sum("rows") - F.count(F.lit(1))).alias("duplicate_ids"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("total").alias("total"),
        F.sum("present").alias("present"),
    ).select("rows", "missing", "duplicate_ids", "min", "max", mean)
