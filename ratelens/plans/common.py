"""Sources and small helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.operators.cleaning import repair_rows, strip_text
from ratelens.operators.features import create_features
from ratelens.operators.splits import monthly_folds
from ratelens.sources.shipments import loads

# Last full month of the star schema is the validation month, as in the published setup.
CUT = date(2001, 10, 1)
FOLDS = monthly_folds(date(2001, 7, 1), 4)

# The published forest; depth 0 is unbounded.
PUBLISHED = {"numTrees": 300, "maxFeatures": 0.8, "minSamplesLeaf": 2, "maxDepth": 0}

NUMERIC_INPUTS = ["distance", "weight", "market_index", "quote_signal"]


@dataclass(frozen=True)
class Query:
    """A plan and, where SQL can express it, its equivalent statement."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def clean(spark: SparkSession, folder: str) -> DataFrame:
    """Stripped and repaired loads (the view holds no copies, so nothing to de-duplicate)."""
    return loads(spark, folder).transform(strip_text).transform(repair_rows)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned loads with the derived columns."""
    return create_features(clean(spark, folder))


# Means of rates with four decimals over 2^k rows often end exactly half-way between two
# rounded values, and engines that add in another order then round apart. This shift moves
# such values off the half-way point; both sides of a comparison apply it.
HALF_WAY_SHIFT = 3e-8


def rounded_mean(df: DataFrame, column: str) -> DataFrame:
    """Round a group mean to six digits, off the half-way point."""
    return df.withColumn(column, F.round(F.col(column) + HALF_WAY_SHIFT, 6))


def rounded_mean_sql(expression: str) -> str:
    """``rounded_mean`` as SQL text."""
    return f"round({expression} + {HALF_WAY_SHIFT}, 6)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for comparison with another engine."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
