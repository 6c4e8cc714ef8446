"""Load records derived from an order-line star schema (lineitem, orders, part, ...).

The star schema has no shipments, coordinates or missing values, so ``loads`` builds them
from its columns, with dirt planted on natural conditions. No broadcast hints: Spark
broadcasts the dimension sides only while their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the star schema."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table that is stored in fewer splits than there are cores.

    A table of cluster size has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def place_coords(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension ``place, lat, lon`` (one row per nation)."""
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("place"),
        (F.lit(25.0) + (key * 7) % 24).alias("lat"),
        (F.lit(-122.0) + (key * 11) % 50).alias("lon"),
    )


def loads(spark: SparkSession, folder: str) -> DataFrame:
    """Raw load table: padded names, impossible values, bad dates and nulls included."""
    nation = table(spark, folder, "nation")
    origin = table(spark, folder, "supplier").join(
        nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("from_name")),
        "s_nationkey",
    )
    target = table(spark, folder, "customer").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_name")),
        "c_nationkey",
    )
    lines = (
        spread(table(spark, folder, "lineitem"))
        .join(
            table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey"
        )
        .join(origin.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "from_name"), "l_suppkey")
        .join(
            table(spark, folder, "orders")
            .select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
            .join(
                target.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "to_name"), "o_custkey"
            ),
            "l_orderkey",
        )
    )
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    flag, priority = F.col("l_returnflag"), F.col("o_orderpriority")
    market = 0.9 + F.col("l_tax") * 2.5
    from_key, to_key = F.col("s_nationkey"), F.col("c_nationkey")

    def lat(key):
        return F.lit(25.0) + (key * 7) % 24

    def lon(key):
        return F.lit(-122.0) + (key * 11) % 50

    ids = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return lines.select(
        F.concat(F.lit("L"), F.concat_ws("-", *ids)).alias("load_id"),
        F.when(line == 5, F.concat(F.lit("  "), "from_name", F.lit(" ")))
        .otherwise(F.col("from_name"))
        .alias("pickup"),
        F.col("to_name").alias("delivery"),
        lat(from_key).alias("pickup_lat"),
        F.when((line == 4) & (qty == 4), -200.0).otherwise(lon(from_key)).alias("pickup_lon"),
        F.when((line == 3) & (qty == 3), 95.0).otherwise(lat(to_key)).alias("delivery_lat"),
        lon(to_key).alias("delivery_lon"),
        F.when((line == 1) & (qty == 1), 0.0)
        .when((line == 2) & (qty == 2), -62.5)
        .otherwise(62.5 * qty)
        .alias("distance"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Dry Van")
        .when(priority.isin("3-MEDIUM", "5-LOW"), "Reefer")
        .when(line == 7, F.lit(None))
        .otherwise("Flatbed")
        .alias("equipment"),
        F.when((line == 7) & (flag == "A"), F.lit(None))
        .when((line == 6) & (qty == 6), -1000.0)
        .otherwise(1000.0 * F.col("p_size"))
        .alias("weight"),
        F.when((line == 2) & (qty == 50), "not-a-date")
        .otherwise(F.substring(F.col("l_shipdate").cast("string"), 1, 10))
        .alias("date"),
        F.when((line == 6) & (flag == "R"), F.lit(None)).otherwise(market).alias("market_index"),
        (1.5 + F.col("l_discount") * 10.0).alias("quote_signal"),
        (150.0 + 2.0 * 62.5 * qty * market + F.col("l_extendedprice") / 100.0).alias("posted_rate"),
    )


def loads_raw(spark: SparkSession, folder: str) -> DataFrame:
    """``loads`` plus exact copies and copies that differ only by padding."""
    padded = F.concat(F.lit(" "), "pickup", F.lit("  "))
    spellings = (
        F.when(F.col("delivery") == "NATION_3", F.array("pickup", "pickup"))
        .when(F.col("delivery") == "NATION_4", F.array(F.col("pickup"), padded))
        .otherwise(F.array("pickup"))
    )
    base = loads(spark, folder)
    return base.withColumn("pickup", F.explode(spellings)).select(*base.columns)
