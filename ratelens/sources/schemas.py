"""Column names and types of the tables the library reads and publishes."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "load_id"
TARGET = "posted_rate"
PREDICTION = "predicted_rate"

# Load table, one entry per column.
LOAD_TYPES = {
    "load_id": T.StringType(),
    "pickup": T.StringType(),
    "delivery": T.StringType(),
    "pickup_lat": T.DoubleType(),
    "pickup_lon": T.DoubleType(),
    "delivery_lat": T.DoubleType(),
    "delivery_lon": T.DoubleType(),
    "distance": T.DoubleType(),
    "equipment": T.StringType(),
    "weight": T.DoubleType(),
    "date": T.DateType(),
    "market_index": T.DoubleType(),
    "quote_signal": T.DoubleType(),
    "posted_rate": T.DoubleType(),
    "predicted_rate": T.DoubleType(),
}

# Published column lists, in order.
PREDICTION_COLUMNS = ["load_id", "predicted_rate"]
SCENARIO_COLUMNS = ["pickup", "delivery", "distance", "equipment", "weight", "date", "predicted_rate"]

# Texts a CSV scan reads as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def numeric_columns(schema: T.StructType) -> list[str]:
    """Names of numeric (and boolean) columns, in table order."""
    return [f.name for f in schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(schema: T.StructType) -> list[str]:
    """Names of string columns, in table order."""
    return [f.name for f in schema if isinstance(f.dataType, T.StringType)]


def date_named_columns(schema: T.StructType) -> list[str]:
    """Names containing "date" in any case, in table order."""
    return [f.name for f in schema if "date" in f.name.lower()]
