"""Chronological splits: holdout and expanding-window folds."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.sources.schemas import KEY


@dataclass(frozen=True)
class Fold:
    """Validation window [start, end); everything before ``start`` is training data."""

    name: str
    start: date
    end: date


# Default holdout cut and the first month of the default folds.
HOLDOUT_CUT = date(2025, 10, 1)
FIRST_VALIDATION_MONTH = date(2025, 7, 1)


def _next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def monthly_folds(first: date = FIRST_VALIDATION_MONTH, months: int = 4) -> list[Fold]:
    """Consecutive one-month validation windows, named like ``June → July``."""
    folds = []
    start = first
    for _ in range(months):
        before = calendar.month_name[(start.month - 2) % 12 + 1]
        folds.append(Fold(f"{before} → {calendar.month_name[start.month]}", start, _next_month(start)))
        start = _next_month(start)
    return folds


def drop_undated(df: DataFrame, column: str = "date") -> DataFrame:
    """Remove rows without a date."""
    return df.dropna(subset=[column])


def holdout(df: DataFrame, cut: date, column: str = "date") -> tuple[DataFrame, DataFrame]:
    """(rows before ``cut``, rows from ``cut`` on); undated rows are in neither."""
    return df.where(F.col(column) < F.lit(cut)), df.where(F.col(column) >= F.lit(cut))


def split_report(df: DataFrame, cut: date, column: str = "date") -> DataFrame:
    """``role, rows, min_date, max_date`` of both sides of a holdout, in one aggregation."""
    role = F.when(F.col(column) < F.lit(cut), "train").otherwise("valid")
    return (
        drop_undated(df, column)
        .groupBy(role.alias("role"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("min_date"), F.max(column).alias("max_date"))
        .orderBy("role")
    )


def fold_windows(folds: Sequence[Fold]) -> Column:
    """The fold list as an array literal."""
    return F.array(
        *[
            F.struct(F.lit(f.name).alias("fold"), F.lit(f.start).alias("start"), F.lit(f.end).alias("end"))
            for f in folds
        ]
    )


def assign_folds(df: DataFrame, folds: Sequence[Fold], column: str = "date") -> DataFrame:
    """One row per (row, fold it belongs to) with ``fold`` and ``role``.

    Membership is an array filter inside the projection: no join, no shuffle, and a row is
    repeated only for the folds that use it. Meant for light grouped statistics; model fits
    filter the cached table instead (``fold_frames``).
    """
    day = F.col(column)
    member = F.explode(F.filter(fold_windows(folds), lambda f: day < f["end"]))
    return (
        df.withColumn("__f", member)
        .withColumn("fold", F.col("__f.fold"))
        .withColumn("role", F.when(day < F.col("__f.start"), "train").otherwise("valid"))
        .drop("__f")
    )


def fold_frames(df: DataFrame, fold: Fold, column: str = "date") -> tuple[DataFrame, DataFrame]:
    """(training rows, validation rows) of one fold as plain filters."""
    day = F.col(column)
    return df.where(day < F.lit(fold.start)), df.where((day >= F.lit(fold.start)) & (day < F.lit(fold.end)))


def in_date_order(df: DataFrame, column: str = "date", key: str = KEY) -> DataFrame:
    """Global date order for output, undated rows last. Fits do not need it."""
    return df.orderBy(F.asc_nulls_last(column), F.asc_nulls_last(key))
