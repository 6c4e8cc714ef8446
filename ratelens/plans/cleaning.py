"""Cleaning queries (CL-1 .. CL-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.operators import cleaning as c
from ratelens.plans.common import Query
from ratelens.plans.sql import over
from ratelens.sources.shipments import loads, loads_raw

_PLACES = "pickup_lat, pickup_lon, delivery_lat, delivery_lon"

QUERIES = {
    "cl1_strip_text": Query(
        lambda s, d: c.strip_text(loads_raw(s, d)),
        over(
            "loads_raw",
            """SELECT * REPLACE (trim(load_id) AS load_id, trim(pickup) AS pickup, trim(delivery) AS delivery,
            trim(equipment) AS equipment, trim(date) AS date) FROM loads_raw""",
        ),
    ),
    "cl2_drop_duplicate_rows": Query(
        lambda s, d: c.drop_duplicate_rows(c.strip_text(loads_raw(s, d))),
        over(
            "loads_raw",
            """SELECT DISTINCT * REPLACE (trim(load_id) AS load_id, trim(pickup) AS pickup,
            trim(delivery) AS delivery, trim(equipment) AS equipment, trim(date) AS date) FROM loads_raw""",
        ),
    ),
    "cl2_removed_rows": Query(
        lambda s, d: c.strip_text(loads_raw(s, d))
        .groupBy(*loads_raw(s, d).columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("before"), F.count(F.lit(1)).alias("after"))
        .select("before", "after", (F.col("before") - F.col("after")).alias("removed")),
        over(
            "loads_raw",
            """SELECT b AS before, a AS after, b - a AS removed FROM
            (SELECT (SELECT count(*) FROM loads_raw) AS b,
            (SELECT count(*) FROM (SELECT DISTINCT * REPLACE (trim(pickup) AS pickup) FROM loads_raw) x) AS a) y""",
        ),
    ),
    "cl3_parse_dates": Query(
        lambda s, d: c.parse_dates(loads(s, d)).select("load_id", "date"),
        over("loads", "SELECT load_id, try_cast(date AS DATE) AS date FROM loads"),
    ),
    "cl4_5_null_negatives": Query(
        lambda s, d: c.null_negatives(loads(s, d)).select("load_id", "weight", "distance"),
        over(
            "loads",
            """SELECT load_id, CASE WHEN weight < 0 THEN NULL ELSE weight END AS weight,
            CASE WHEN distance < 0 THEN NULL ELSE distance END AS distance FROM loads""",
        ),
    ),
    "cl6_7_null_bad_coordinates": Query(
        lambda s, d: c.null_bad_coordinates(loads(s, d)).select("load_id", *c.COORDINATE_RANGES),
        over("clean", f"SELECT load_id, {_PLACES} FROM clean"),
    ),
    "cl8_clean_loads": Query(
        lambda s, d: c.clean_loads(loads_raw(s, d)),
        over("cleaned", "SELECT * FROM cleaned"),
    ),
}
