"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelens.sources.files import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_of(column: str = "text") -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def map_text(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    work: Callable[[list[bytes], pa.RecordBatch], list[pa.Array]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Append the columns that ``work`` makes of each batch's texts (UTF-8 bytes, null as empty).

    Columns in ``drop`` are read but not returned, which spares their way back. The texts of a batch are bounded by
    Spark's Arrow batch limits, and only one batch is held.
    """
    at = df.columns.index(column)
    keep = [i for i, c in enumerate(df.columns) if c not in drop]
    names = [f"_c{i}" for i in range(len(keep) + len(fields))]  # a frame's own names may hold dots
    kinds = [*[df.schema.fields[i] for i in keep], *fields]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            new = work(texts, batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *new], names=names)

    return set_aside(df).mapInArrow(run, schema).toDF(*[f.name for f in kinds])


def set_aside(df: DataFrame) -> DataFrame:
    """The same columns under neutral names, so that they clash with no column an operator adds."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
