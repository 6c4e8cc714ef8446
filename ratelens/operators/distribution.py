"""Distribution statistics: describe, moments, quantiles, histograms, densities, box and
outlier statistics, correlations.

Statistics that need a bound first (bins, whiskers) read the table twice: the first pass
ends in one row, used as a scalar subquery, in one row per column, broadcast (the columns
bound it), or in one row per data group, joined on the group once its size is known.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import equal_width_bin, finite
from ratelens.functions.quantiles import group_table, hand_over, quantiles

# Quartiles, the extended quantile list and the whisker reach.
QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
DISTANCE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
WHISKER = 1.5
GRID_POINTS = 200
# Bandwidths beyond which exp(-z * z / 2) is zero in double precision.
REACH = 38.7


def numeric_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., column, value`` with finite doubles only (NaN and infinities become NULL)."""
    doubles = [finite(F.col(c).cast("double")).alias(f"__v_{c}") for c in columns]
    wide = df.select(*keep, *doubles)
    long = wide.unpivot(list(keep), [f"__v_{c}" for c in columns], "column", "value")
    return long.withColumn("column", F.expr("substr(column, 5)"))


def describe(df: DataFrame, columns: Sequence[str], exact: bool = True, kept: bool = False) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max of the non-null values.

    ``kept`` says that ``df`` is a scan of a stored table, which need not be written once more.
    """
    value = F.col("value")
    given = df.select(*columns)
    return quantiles(
        numeric_long(given if kept else hand_over(given), columns),
        "value",
        QUARTILES,
        by=["column"],
        few_groups=True,
        aggregates=[
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        ],
        exact=exact,
    ).select("column", "count", "mean", "std", "min", "25%", "50%", "75%", "max")


def column_quantiles(
    df: DataFrame, column: str, probabilities: Mapping[str, float] = DISTANCE_QUANTILES, exact: bool = True
) -> DataFrame:
    """``quantile, value`` rows of one column, linear interpolation."""
    names = list(probabilities)
    wide = quantiles(hand_over(df.select(column)), finite(F.col(column)), probabilities, exact=exact)
    return wide.unpivot([], names, "quantile", "value")


def moments(df: DataFrame, column: str) -> DataFrame:
    """Sample-corrected ``skewness, kurtosis`` of one column.

    The built-in aggregates are population statistics and raise on a constant column, so a
    constant or too short column is mapped to NULL beforehand.
    """
    value = finite(F.col(column))
    bounds = df.select(value.alias("v")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    spread = bounds.select((F.col("lo") < F.col("hi")).alias("s")).scalar()
    rows = df.select(F.when(spread, value).alias("v"))
    n = F.col("n")
    return (
        rows.agg(
            F.count("v").cast("double").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")
        )
        .select(
            F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).alias("skewness"),
            F.when(
                n > 3,
                (n - 1)
                / F.nullif((n - 2) * (n - 3), F.lit(0.0))
                * ((n + 1) * F.col("g2") + 6),
            ).alias("kurtosis"),
        )
    )


def _bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        numeric_long(df, columns)
        .groupBy("column")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
        .where(F.col("n") > 0)
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width histograms: ``column, bin, left, right, count``, empty bins included."""
    bounds = _bounds(df, columns)
    counts = (
        numeric_long(df, columns)
        .where(F.col("value").isNotNull())
        .join(F.broadcast(bounds), "column")
        .groupBy("column", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    flat = F.col("lo") == F.col("hi")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    width = (hi - lo) / bins
    frame = bounds.select(
        "column", lo.alias("lo"), width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b")
    )
    frame = frame.withColumn("bin", F.col("b").cast("bigint"))
    return frame.join(counts, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + F.col("width") * F.col("bin")).alias("left"),
        (F.col("lo") + F.col("width") * (F.col("bin") + 1)).alias("right"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def density_curve(df: DataFrame, columns: Sequence[str], points: int = GRID_POINTS) -> DataFrame:
    """Gaussian kernel density on an even grid over each column's range: ``column, point, x, density``.

    Scott bandwidth ``std * n ** (-1/5)``. Exact: equal values are counted first, then every
    distinct value adds its kernel to the sums of the grid points within ``REACH`` bandwidths, beyond
    which a double holds no part of it. The sums combine map-side, so the last shuffle carries at
    most ``points`` rows per task and column; the bandwidth, and with it the terms of a value,
    shrink as the table grows.
    """
    value = F.col("value")
    long = numeric_long(hand_over(df.select(*columns)), columns).where(value.isNotNull())
    facts = (
        long.groupBy("column")
        .agg(
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
            F.count(value).alias("n"),
            F.stddev_samp(value).alias("sd"),
        )
        .where((F.col("n") > 1) & (F.col("sd") > 0))
        .select(
            "column",
            "lo",
            "n",
            ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
            (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        )
    )
    weights = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("w"))
    x = F.col("lo") + F.col("step") * F.col("point")
    kernel = F.exp(-0.5 * F.pow((x - value) / F.col("h"), 2)) * F.col("w")
    first = F.greatest(F.lit(0), F.ceil((value - REACH * F.col("h") - F.col("lo")) / F.col("step"))).cast("int")
    last = F.least(F.lit(points - 1), F.floor((value + REACH * F.col("h") - F.col("lo")) / F.col("step"))).cast("int")
    # A value between two grid points may reach none of them.
    near = F.when(first <= last, F.sequence(first, last))
    sums = (
        weights.join(F.broadcast(facts), "column")
        .withColumn("point", F.explode(near))
        .groupBy("column", "point")
        .agg(F.sum(kernel).alias("total"))
    )
    grid = facts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    density = F.coalesce("total", F.lit(0.0)) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return grid.join(sums, ["column", "point"], "left").select("column", "point", x.alias("x"), density.alias("density"))


def box_stats(df: DataFrame, value: str, by: str | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR of the box) and outlier count.

    One row, or one row per non-null ``by`` value. Outliers are strictly beyond the fences.
    """
    keys = [by] if by else []
    rows = hand_over(df.select(*keys, finite(F.col(value).cast("double")).alias("v")))
    box = quantiles(rows, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=keys, exact=exact)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    fences = box.withColumns({"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach})
    edge = [*keys, "q1", "median", "q3", "low_fence", "high_fence"]
    if by:
        joined = rows.where(F.col(by).isNotNull()).join(group_table(fences.select(*edge)), by)
    else:
        scalar = fences.select(F.struct(*edge).alias("f")).scalar()
        joined = rows.withColumn("__f", scalar).select("v", "__f.*")
    inside = F.col("v").between(F.col("low_fence"), F.col("high_fence"))
    return (
        joined.groupBy(*edge)
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(*keys, "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    )


def density_grid(df: DataFrame, x: Sequence[str], y: str, bins: int = 50) -> DataFrame:
    """Scatter of each ``x`` column against ``y`` as counts on an even grid.

    ``column, x_bin, y_bin, count`` over the rows where both are present.
    """
    named = df.withColumn("__y", finite(F.col(y).cast("double"))).where(F.col("__y").isNotNull())
    pairs = numeric_long(named, x, keep=["__y"]).where(F.col("value").isNotNull())
    bounds = pairs.groupBy("column").agg(
        F.min("value").alias("x_lo"), F.max("value").alias("x_hi"), F.min("__y").alias("y_lo"), F.max("__y").alias("y_hi")
    )
    return (
        pairs.join(F.broadcast(bounds), "column")
        .groupBy(
            "column",
            equal_width_bin(F.col("value"), F.col("x_lo"), F.col("x_hi"), bins).alias("x_bin"),
            equal_width_bin(F.col("__y"), F.col("y_lo"), F.col("y_hi"), bins).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; NULL (not an error) when either side is constant.

    The built-in ``corr`` raises on a constant side, the regression aggregates do not: the
    slope is NULL for a constant ``x`` and 0 for a constant ``y``, and its sign is the sign
    of the correlation.
    """
    slope = F.regr_slope(y, x)
    return F.when(slope != 0, F.signum(slope) * F.sqrt(F.regr_r2(y, x))).when(
        F.regr_r2(y, x) < 1, F.lit(0.0)
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix as ``column, other, correlation`` rows, in one scan.

    Each row is unfolded to its pairs inside the map task and combined there per pair: one
    small aggregation over more rows compiles and runs better than hundreds of aggregates
    side by side, and the shuffle carries one row per task and pair.
    """
    doubles = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    values = [
        F.struct(F.lit(i).alias("i"), F.col(columns[a]).alias("x"), F.col(columns[b]).alias("y"))
        for i, (a, b) in enumerate(pairs)
    ]
    upper = (
        doubles.select(F.inline(F.array(*values)))
        .groupBy("i")
        .agg(pearson(F.col("x"), F.col("y")).alias("correlation"))
    )
    names = [(i, columns[a], columns[b]) for i, (a, b) in enumerate(pairs)]
    names += [(i, columns[b], columns[a]) for i, (a, b) in enumerate(pairs) if a != b]
    cells = df.sparkSession.createDataFrame(names, "i int, column string, other string")
    same = (F.col("column") == F.col("other")) & F.col("correlation").isNotNull()
    # One row per pair of columns on either side.
    return cells.join(F.broadcast(upper), "i", "left").select(
        "column", "other", F.when(same, F.lit(1.0)).otherwise(F.col("correlation")).alias("correlation")
    )


def target_correlations(df: DataFrame, columns: Sequence[str], target: str, include_self: bool = True) -> DataFrame:
    """Correlation of each column with the target; one scan computes only these pairs.

    With the target itself: descending. Without it: ascending. NULL correlations come last.
    """
    y = finite(F.col(target).cast("double"))
    others = [c for c in columns if c != target]
    cells = [
        F.struct(
            F.lit(c).alias("column"), pearson(finite(F.col(c).cast("double")), y).alias("correlation")
        )
        for c in others
    ]
    if include_self:
        cells.append(
            F.struct(
                F.lit(target).alias("column"), F.when(F.min(y) < F.max(y), F.lit(1.0)).alias("correlation")
            )
        )
    rows = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    order = F.desc_nulls_last("correlation") if include_self else F.asc_nulls_last("correlation")
    return rows.orderBy(order, "column")


def outlier_summary(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Per column: quartiles, IQR, fences, count strictly outside and its share in percent."""
    long = numeric_long(hand_over(df.select(*columns)), columns)
    box = quantiles(long, "value", {"q1": 0.25, "q3": 0.75}, by=["column"], exact=exact, few_groups=True)
    iqr = F.col("q3") - F.col("q1")
    fences = box.select(
        "column", "q1", "q3", iqr.alias("iqr"), (F.col("q1") - WHISKER * iqr).alias("lower"),
        (F.col("q3") + WHISKER * iqr).alias("upper"),
    )
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    counted = long.join(F.broadcast(fences), "column").groupBy(*fences.columns)
    return counted.agg(
        F.count_if(outside).alias("outliers"),
        (F.count_if(outside) * 100.0 / F.nullif(F.count("value"), F.lit(0).cast("bigint"))).alias("outlier_pct"),
    )


def above_upper_fence(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is above Q3 + 1.5 IQR of the whole table."""
    box = quantiles(hand_over(df.select(column)), finite(F.col(column)), {"q1": 0.25, "q3": 0.75})
    upper = box.select((F.col("q3") + WHISKER * (F.col("q3") - F.col("q1"))).alias("upper")).scalar()
    return df.where(F.col(column) > upper)
