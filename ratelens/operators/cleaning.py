"""Row repairs and exact de-duplication of a load table.

Invalid values become NULL; rows are only ever removed by ``drop_duplicate_rows``.
Columns are optional: a rule for an absent column does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.columns import as_day, strip
from ratelens.sources.schemas import date_named_columns, text_columns

# Physically possible coordinate ranges, in degrees, bounds included.
COORDINATE_RANGES = {
    "pickup_lat": (-90.0, 90.0),
    "pickup_lon": (-180.0, 180.0),
    "delivery_lat": (-90.0, 90.0),
    "delivery_lon": (-180.0, 180.0),
}

# Columns whose negative values are impossible.
NON_NEGATIVE = ("weight", "distance")


def strip_text(df: DataFrame) -> DataFrame:
    """Trim Unicode whitespace around every string value; case is left alone."""
    return df.withColumns({c: strip(F.col(c)) for c in text_columns(df.schema)})


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of every set of fully equal rows (NULLs are equal)."""
    return df.dropDuplicates()


def parse_dates(df: DataFrame, fmt: str | None = None) -> DataFrame:
    """Turn every column with "date" in its name into a date; unparseable becomes NULL."""
    return df.withColumns(
        {c: as_day(F.col(c), df.schema[c].dataType, fmt) for c in date_named_columns(df.schema)}
    )


def null_negatives(df: DataFrame) -> DataFrame:
    """Negative weight and distance become NULL; zero stays."""
    present = [c for c in NON_NEGATIVE if c in df.columns]
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in present})


def null_bad_coordinates(df: DataFrame) -> DataFrame:
    """Coordinates outside their range become NULL."""
    present = {c: r for c, r in COORDINATE_RANGES.items() if c in df.columns}
    return df.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in present.items()})


def null_empty_text(df: DataFrame) -> DataFrame:
    """Empty strings become NULL, as they would after a CSV hand-over."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text_columns(df.schema)})


def repair_rows(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """All row repairs after stripping: dates, negatives, coordinates, empty text."""
    return (
        df.transform(parse_dates, date_format)
        .transform(null_negatives)
        .transform(null_bad_coordinates)
        .transform(null_empty_text)
    )


def clean_loads(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Full cleaning in contract order: strip, de-duplicate, then repair.

    The one shuffle is the de-duplication; statistical outliers are kept on purpose.
    """
    return df.transform(strip_text).transform(drop_duplicate_rows).transform(repair_rows, date_format)
