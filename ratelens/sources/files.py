"""Readers and writers for tables on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.errors import ContractError
from ratelens.functions.columns import as_day, not_nan
from ratelens.session import ensure_checkpoint_folder
from ratelens.sources.schemas import LOAD_TYPES, NA_TOKENS


def read_csv(
    spark: SparkSession,
    path: str,
    label: str = "table",
    types: Mapping[str, T.DataType] = LOAD_TYPES,
    date_format: str | None = None,
) -> DataFrame:
    """Header CSV scan with declared types and the usual missing-value texts as NULL.

    Column names come from the header; known columns are typed from ``types`` (no inference
    pass over the data) and the others stay text. A path that cannot be read raises
    ``ContractError`` naming ``label``.
    """
    try:
        raw = spark.read.csv(path, header=True, inferSchema=False, nullValue="", emptyValue="")
    except AnalysisException as exc:
        raise ContractError(f"could not read {label} at {path}: {exc.getCondition()}") from exc
    return raw.select(*[_typed(c, types.get(c), date_format).alias(c) for c in raw.columns])


def column_types(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """``column, type, present, missing, integers, numbers, dates`` of a table of texts, from one scan.

    The type is the least one that holds every value: ``integer`` (without missing values), ``double``, ``date``, else
    ``text``; a column without values is ``double``. Counts of what parses as each add up over tasks, so no task needs to
    see all values and a single text keeps a column text.
    """
    facts = []
    for name in raw.columns:
        column = F.col(f"`{name}`")
        value = F.when(~F.coalesce(column.isin(NA_TOKENS), F.lit(True)), column)
        whole = value.rlike(r"^\s*[+-]?[0-9]+\s*$") & value.try_cast("bigint").isNotNull()
        facts.append(
            F.struct(
                F.lit(name).alias("column"), F.count(value).alias("present"), F.count_if(value.isNull()).alias("missing"),
                F.count_if(whole).alias("integers"), F.count(value.try_cast("double")).alias("numbers"),
                # A bare number would pass for a year.
                F.count(F.when(value.try_cast("double").isNull(), as_day(value, T.StringType(), date_format))).alias("dates"),
            )
        )
    rows = raw.agg(F.array(*facts).alias("f")).select(F.inline("f"))
    present = F.col("present")
    kind = (
        F.when((F.col("integers") == present) & (F.col("missing") == 0) & (present > 0), "integer")
        .when(F.col("numbers") == present, "double")
        .when(F.col("dates") == present, "date")
        .otherwise("text")
    )
    return rows.select("column", kind.alias("type"), "present", "missing", "integers", "numbers", "dates")


def read_csv_discovered(spark: SparkSession, path: str, label: str = "table", date_format: str | None = None) -> DataFrame:
    """Header CSV scan whose types come from the data (``column_types``): nothing that is present becomes NULL."""
    raw = read_csv(spark, path, label, types={})
    kinds = {"integer": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "text": T.StringType()}
    # One row per column.
    found = {r["column"]: kinds[r["type"]] for r in column_types(raw, date_format).collect()}
    return raw.select(*[_typed(c, found[c], date_format).alias(c) for c in raw.columns])


def widened_columns(raw: DataFrame, types: Mapping[str, T.DataType] = LOAD_TYPES) -> DataFrame:
    """``column, declared, type, lost``: columns whose values do not all fit the declared type, and how many do not.

    Reading such a column as declared gives NULL for these values, reading it as discovered keeps them as text.
    """
    declared = [(c, types[c].simpleString()) for c in raw.columns if c in types and not isinstance(types[c], T.StringType)]
    wanted = raw.sparkSession.createDataFrame(declared, "column string, declared string")
    found = column_types(raw).join(F.broadcast(wanted), "column")
    fits = F.when(F.col("declared") == "date", F.col("dates")).otherwise(F.col("numbers"))
    return found.select("column", "declared", "type", (F.col("present") - fits).alias("lost")).where("lost > 0")


def _typed(name: str, data_type: T.DataType | None, date_format: str | None):
    column = F.col(f"`{name}`")
    present = F.when(~column.isin(NA_TOKENS), column)
    if isinstance(data_type, T.DateType):
        return as_day(present, T.StringType(), date_format)
    if isinstance(data_type, T.DoubleType):
        return not_nan(present.try_cast(data_type))
    return present.try_cast(data_type) if data_type else present


def read_parquet(spark: SparkSession, path: str, label: str = "table") -> DataFrame:
    """Parquet scan; a path that cannot be read raises ``ContractError`` naming ``label``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        raise ContractError(f"could not read {label} at {path}: {exc.getCondition()}") from exc


def scan_report(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``label, readable, rows`` of guarded Parquet scans; a path that cannot be read has no rows."""
    reports = []
    for label, path in paths.items():
        try:
            counted = read_parquet(spark, path, label).agg(F.count(F.lit(1)).alias("rows"))
            reports.append(counted.select(F.lit(label).alias("label"), F.lit(True).alias("readable"), "rows"))
        except ContractError:
            reports.append(spark.createDataFrame([(label, False, None)], "label string, readable boolean, rows long"))
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Write a header CSV, optionally projected to an exact column list.

    ``path`` must not be one the plan reads from: Spark deletes the target first.
    """
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").csv(
        path,
        header=True,
        nullValue="",
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write the hand-over table between stages; partition by month to prune later scans.

    Rows of a partition value are brought together first (large ones over several tasks), so
    each task writes few files instead of one per value.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares for checkpoints."""
    base = ensure_checkpoint_folder(spark)
    return f"{base.rstrip('/')}/ratelens/{name}-{uuid.uuid4().hex}"
