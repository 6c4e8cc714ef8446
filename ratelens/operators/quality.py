"""Data-quality reports. Each report is a small lazy DataFrame; guards run one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.errors import ContractError
from ratelens.functions.columns import as_day
from ratelens.operators.cleaning import COORDINATE_RANGES
from ratelens.operators.distribution import describe
from ratelens.sources.schemas import KEY, TARGET, date_named_columns, numeric_columns, text_columns

# Report-only rules, (name, column, test against zero).
ZERO_RULES = (
    ("negative_weight", "weight", "<"),
    ("zero_weight", "weight", "="),
    ("negative_distance", "distance", "<"),
    ("negative_market_index", "market_index", "<"),
)

# Columns derived from the target that must never become features.
TARGET_DERIVED = ("rate_per_mile",)


def long_table(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Unpivot named expressions of one type to ``column, value`` rows (a map-side expand)."""
    named = df.select(*[expr.alias(name) for name, expr in columns.items()])
    return named.unpivot([], list(columns), "column", "value")


def schema_report(df: DataFrame) -> DataFrame:
    """``position, column, dtype`` of every column; no data is read."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def shape_report(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint")
    )


def head(df: DataFrame, rows: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """First rows as the scan returns them, or in a given order."""
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def quality_report(df: DataFrame) -> DataFrame:
    """Per column: dtype, missing, missing %, distinct values, repeated values.

    Values are counted per ``(column, value)`` first, so the distinct count is a plain
    two-level aggregation with map-side combine and a value shared by a third of the rows
    reaches the shuffle as one row per task.
    """
    texts = {f.name: _comparable_text(f) for f in df.schema}
    counts = long_table(df, texts).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique"),
    )
    missing = F.coalesce("missing", F.lit(0).cast("bigint"))
    unique = F.coalesce("unique", F.lit(0).cast("bigint"))
    rows = F.coalesce("rows", F.lit(0).cast("bigint"))
    return (
        schema_report(df)
        .join(stats, "column", "left")
        .orderBy("position")
        .select(
            "column",
            "dtype",
            missing.alias("missing"),
            F.round(F.col("missing") * 100.0 / F.col("rows"), 2).alias("missing_%"),
            unique.alias("unique"),
            (rows - unique - F.when(missing > 0, 1).otherwise(0)).alias("duplicate_values"),
        )
    )


def _comparable_text(field: T.StructField) -> Column:
    column = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        column = column + F.lit(0.0)  # -0.0 and 0.0 are one value
    return column.cast("string")


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count of the columns that have any: ``column, missing``."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column", "missing").where(F.col("missing") > 0)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier equal row: ``duplicate_rows``."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("duplicate_rows"))


def key_report(df: DataFrame, key: str = KEY) -> DataFrame:
    """``key_present, missing, duplicates``; a missing key column is reported, not fatal."""
    if key not in df.columns:
        row = [(False, None, None)]
        return df.sparkSession.createDataFrame(row, "key_present boolean, missing bigint, duplicates bigint")
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.lit(True).alias("key_present"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), zero).alias("missing"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"),
    )


def possible_repeats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose values of ``columns`` may occur more than once: all that do, and those that only share a hash with another.

    Rows are told by eight bytes each, so that where few repeat only these few are shuffled whole, by whatever looks at them
    next; where most do, the table is returned as it is. It is read twice.
    """
    from ratelens.functions.quantiles import group_table

    mark = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("__mark")
    counts = df.groupBy(mark).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    repeated = group_table(counts)
    if 2 * (repeated.agg(F.sum("__n")).first()[0] or 0) > df.count():
        return df
    return df.withColumn("__mark", mark).join(repeated.select("__mark"), "__mark", "left_semi").select(*df.columns)


def rule_violations(df: DataFrame) -> DataFrame:
    """Counts of impossible or suspicious numbers: ``rule, violations``."""
    rules = {}
    for name, column, test in ZERO_RULES:
        if column in df.columns:
            rules[name] = F.col(column) < 0 if test == "<" else F.col(column) == 0
    counted = df.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def value_range(df: DataFrame, column: str = "quote_signal") -> DataFrame:
    """``min, max`` of one column."""
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def coordinate_report(df: DataFrame) -> DataFrame:
    """Per coordinate: missing, min, max, out-of-range count."""
    present = {c: r for c, r in COORDINATE_RANGES.items() if c in df.columns}
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.count_if(~F.col(c).between(*r)).alias("out_of_range"),
        )
        for c, r in present.items()
    ]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def date_report(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """Per date-named column: missing before, newly invalid, missing after, first and last day."""
    facts = []
    for c in date_named_columns(df.schema):
        day = as_day(F.col(c), df.schema[c].dataType, fmt)
        facts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("original_missing"),
                F.count_if(F.col(c).isNotNull() & day.isNull()).alias("newly_invalid"),
                F.count_if(day.isNull()).alias("final_missing"),
                F.min(day).alias("min_date"),
                F.max(day).alias("max_date"),
            )
        )
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def _text_value_counts(df: DataFrame) -> DataFrame:
    texts = {c: F.col(c) for c in text_columns(df.schema)}
    return long_table(df, texts).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def category_report(df: DataFrame, top: int = 20) -> DataFrame:
    """Per string column: distinct values and the ``top`` most frequent values, NULL included.

    Spark cuts each map task to its own ``top`` rows per column before the window shuffle,
    so a column with billions of distinct values never lands in one task.
    """
    counts = _text_value_counts(df)
    frequent = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = counts.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= top)
    distinct = counts.groupBy("column").agg(F.count("value").alias("unique"))
    return ranked.join(distinct, "column").select("column", "unique", "rank", "value", "n")


def categorical_summary(df: DataFrame) -> DataFrame:
    """Per string column: count, unique, most frequent value (smallest on a tie), its count."""
    counts = _text_value_counts(df).where(F.col("value").isNotNull())
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def numeric_summary(df: DataFrame) -> DataFrame:
    """Per numeric column: count, mean, std, min, exact quartiles, max."""
    return describe(df, numeric_columns(df.schema))


def target_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Missing, min, max, mean, exact median and negative count of the target."""
    from ratelens.functions.quantiles import hand_over, quantiles

    t = F.col(target)
    return quantiles(
        hand_over(df.select(target)),
        target,
        {"median": 0.5},
        aggregates=[
            F.count_if(t.isNull()).alias("missing"),
            F.min(t).alias("min"),
            F.max(t).alias("max"),
            F.avg(t).alias("mean"),
            F.count_if(t < 0).alias("negative"),
        ],
    ).select("missing", "min", "max", "mean", "median", "negative")


def check_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Target checks as rows ``rule, severity, violations, passed``; absence raises."""
    if target not in df.columns:
        raise ContractError(f"target column '{target}' was not found")
    t = F.col(target)
    counted = df.agg(
        F.count_if(t < 0).alias("negative_target"), F.count_if(t.isNull()).alias("missing_target")
    )
    return counted.unpivot([], counted.columns, "rule", "violations").select(
        "rule",
        F.when(F.col("rule") == "negative_target", "error").otherwise("warning").alias("severity"),
        "violations",
        (F.col("violations") == 0).alias("passed"),
    )


def guard_target(df: DataFrame, target: str = TARGET) -> int:
    """Raise when the target is absent or negative somewhere; return the missing count."""
    found = {r["rule"]: r["violations"] for r in check_target(df, target).collect()}
    if found["negative_target"]:
        raise ContractError(f"{found['negative_target']} rows have a negative {target}")
    return found["missing_target"]


def guard_features(columns: Sequence[str], target: str = TARGET) -> list[str]:
    """Feature columns allowed in a model: the target is left out, its derivatives raise."""
    leaked = [c for c in TARGET_DERIVED if c in columns]
    if leaked:
        raise ContractError(f"columns derived from the target must not be features: {leaked}")
    return [c for c in columns if c != target]


def final_report(df: DataFrame, key: str = KEY, target: str = TARGET, kept: bool = False) -> DataFrame:
    """Closing report as ``section, item, value`` rows: shape, duplicates, missing, target.

    ``kept`` says that ``df`` is a scan of a stored table, which need not be written once more.
    """

    def rows(section: str, wide: DataFrame) -> DataFrame:
        texts = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
        return texts.unpivot([], texts.columns, "item", "value").select(
            F.lit(section).alias("section"), "item", "value"
        )

    # Equal rows have equal keys, so a row whose key is the only one of its hash repeats neither.
    again = possible_repeats(df, [key] if key in df.columns else df.columns)
    out = rows("shape", shape_report(df)).unionByName(rows("duplicates", duplicate_rows(again)))
    if key in df.columns:
        out = out.unionByName(rows("duplicates", key_report(again, key).select(F.col("duplicates").alias(key))))
    missing = missing_report(df).select(
        F.lit("missing").alias("section"),
        F.col("column").alias("item"),
        F.col("missing").cast("double").alias("value"),
    )
    out = out.unionByName(missing)
    if target in df.columns:
        out = out.unionByName(rows("target", describe(df, [target], kept=kept).drop("column")))
    return out
