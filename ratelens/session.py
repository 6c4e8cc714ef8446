"""Session settings the library is tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ratelens.errors import ContractError

# Adaptive execution sizes shuffle partitions and splits skewed joins at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes. Wide projections (features) and wide
    # aggregations exceed that as one fused method; split per expression they do not.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def ensure_checkpoint_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and hand-over tables, as the session names it.

    Only a local session without one gets a temporary folder; a cluster must name a folder
    that every executor reaches.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ContractError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="ratelens-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    The checkpoint folder is only chosen here when the environment names none.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ratelens")
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_folder(spark)
    return spark
