"""Scoring of load files as they arrive: the batch scoring plan on a streaming source.

Every micro-batch is scored by the batch functions, since the trees meet the rows by shuffles. De-duplication
is left out: it would need unbounded state.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ratelens.models.evaluation import score_batch
from ratelens.operators.cleaning import repair_rows, strip_text


def load_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Parquet load files of ``folder`` as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def score_stream(loads: DataFrame, model: PipelineModel, target: str, state: str) -> StreamingQuery:
    """Score everything that has arrived since the last run, add it to ``target`` and stop.

    ``state`` (on shared storage) remembers which files are done, so a lost run resumes without scoring a file twice: a
    micro-batch has a folder of its own, ``batch=<number>``, which a repetition replaces.
    """

    def score(rows: DataFrame, number: int) -> None:
        scored = score_batch(rows.transform(strip_text).transform(repair_rows), model)
        scored.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = loads.writeStream.foreachBatch(score).option("checkpointLocation", state)
    return writer.trigger(availableNow=True).start()
