"""Shared SQL text for the equivalent statements (run by another engine on the same tables)."""

from __future__ import annotations

LOADS = """
SELECT concat('L', cast(l.l_orderkey AS string), '-', cast(l.l_linenumber AS string), '-',
              cast(l.l_partkey AS string), '-', cast(l.l_suppkey AS string)) AS load_id,
 CASE WHEN l.l_linenumber = 5 THEN concat('  ', sn.n_name, ' ') ELSE sn.n_name END AS pickup,
 cn.n_name AS delivery,
 25e0 + (sn.n_nationkey * 7) % 24 AS pickup_lat,
 CASE WHEN l.l_linenumber = 4 AND l.l_quantity = 4 THEN -200e0
      ELSE -122e0 + (sn.n_nationkey * 11) % 50 END AS pickup_lon,
 CASE WHEN l.l_linenumber = 3 AND l.l_quantity = 3 THEN 95e0
      ELSE 25e0 + (cn.n_nationkey * 7) % 24 END AS delivery_lat,
 -122e0 + (cn.n_nationkey * 11) % 50 AS delivery_lon,
 CASE WHEN l.l_linenumber = 1 AND l.l_quantity = 1 THEN 0e0
      WHEN l.l_linenumber = 2 AND l.l_quantity = 2 THEN -62.5e0
      ELSE 62.5e0 * l.l_quantity END AS distance,
 CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Dry Van'
      WHEN o.o_orderpriority IN ('3-MEDIUM','5-LOW') THEN 'Reefer'
      WHEN l.l_linenumber = 7 THEN NULL ELSE 'Flatbed' END AS equipment,
 CASE WHEN l.l_linenumber = 7 AND l.l_returnflag = 'A' THEN NULL
      WHEN l.l_linenumber = 6 AND l.l_quantity = 6 THEN -1000e0
      ELSE 1000e0 * p.p_size END AS weight,
 CASE WHEN l.l_linenumber = 2 AND l.l_quantity = 50 THEN 'not-a-date'
      ELSE substr(cast(l.l_shipdate AS string), 1, 10) END AS date,
 CASE WHEN l.l_linenumber = 6 AND l.l_returnflag = 'R' THEN NULL
      ELSE 0.9e0 + l.l_tax * 2.5e0 END AS market_index,
 1.5e0 + l.l_discount * 10e0 AS quote_signal,
 150e0 + 2e0 * 62.5e0 * l.l_quantity * (0.9e0 + l.l_tax * 2.5e0)
       + l.l_extendedprice / 100e0 AS posted_rate
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN part p ON p.p_partkey = l.l_partkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey
"""

LOADS_RAW = """
SELECT * FROM loads
UNION ALL SELECT * FROM loads WHERE delivery = 'NATION_3'
UNION ALL SELECT * REPLACE (concat(' ', pickup, '  ') AS pickup) FROM loads WHERE delivery = 'NATION_4'
"""


def repaired(source: str, distinct: bool = False) -> str:
    """Cleaning rules as one projection."""
    return f"""
SELECT {'DISTINCT' if distinct else ''} load_id, trim(pickup) AS pickup, trim(delivery) AS delivery,
 CASE WHEN pickup_lat BETWEEN -90 AND 90 THEN pickup_lat END AS pickup_lat,
 CASE WHEN pickup_lon BETWEEN -180 AND 180 THEN pickup_lon END AS pickup_lon,
 CASE WHEN delivery_lat BETWEEN -90 AND 90 THEN delivery_lat END AS delivery_lat,
 CASE WHEN delivery_lon BETWEEN -180 AND 180 THEN delivery_lon END AS delivery_lon,
 CASE WHEN distance >= 0 THEN distance END AS distance,
 trim(equipment) AS equipment,
 CASE WHEN weight >= 0 THEN weight END AS weight,
 try_cast(date AS DATE) AS date, market_index, quote_signal, posted_rate
FROM {source}
"""


FEATURES = """
SELECT load_id, pickup, delivery, pickup_lat, pickup_lon, delivery_lat, delivery_lon, distance,
 equipment, weight, date, market_index, quote_signal, posted_rate,
 cast(year(date) AS INTEGER) AS year, cast(month(date) AS INTEGER) AS month,
 cast(day(date) AS INTEGER) AS day, cast(isodow(date) - 1 AS INTEGER) AS day_of_week,
 cast(week(date) AS DOUBLE) AS week_of_year, cast(dayofyear(date) AS INTEGER) AS day_of_year,
 cast(coalesce(isodow(date) >= 6, false) AS INTEGER) AS is_weekend,
 cast(coalesce(day(date) = 1, false) AS INTEGER) AS is_month_start,
 cast(coalesce(date = last_day(date), false) AS INTEGER) AS is_month_end,
 concat(coalesce(pickup, 'nan'), ' -> ', coalesce(delivery, 'nan')) AS route,
 delivery_lat - pickup_lat AS lat_diff, delivery_lon - pickup_lon AS lon_diff,
 abs(delivery_lat - pickup_lat) AS abs_lat_diff, abs(delivery_lon - pickup_lon) AS abs_lon_diff,
 2 * 3958.8e0 * asin(sqrt(
   CASE WHEN hav > 1 THEN 1 WHEN hav < 0 THEN 0 ELSE hav END)) AS geo_distance,
 ln(1 + CASE WHEN distance < 0 THEN 0 ELSE distance END) AS log_distance,
 CASE WHEN distance <= 250 THEN 'very_short' WHEN distance <= 500 THEN 'short'
      WHEN distance <= 1000 THEN 'medium' WHEN distance <= 1500 THEN 'long'
      WHEN distance <= 2500 THEN 'very_long' WHEN distance > 2500 THEN 'extreme' END AS distance_bucket,
 ln(1 + CASE WHEN weight < 0 THEN 0 ELSE weight END) AS log_weight,
 CASE WHEN weight <= 10000 THEN 'very_light' WHEN weight <= 20000 THEN 'light'
      WHEN weight <= 30000 THEN 'medium' WHEN weight <= 40000 THEN 'heavy'
      WHEN weight > 40000 THEN 'very_heavy' END AS weight_bucket,
 weight / nullif(distance, 0) AS weight_per_distance,
 market_index - 1 AS market_index_deviation, quote_signal - 2 AS quote_signal_deviation,
 quote_signal * quote_signal AS quote_signal_squared,
 distance * weight AS distance_x_weight, distance * market_index AS distance_x_market,
 distance * quote_signal AS distance_x_quote
FROM (SELECT *, pow(sin(radians(delivery_lat - pickup_lat) / 2), 2)
        + cos(radians(pickup_lat)) * cos(radians(delivery_lat))
        * pow(sin(radians(delivery_lon - pickup_lon) / 2), 2) AS hav FROM clean) x
"""

_CTES = {
    "loads": LOADS,
    "loads_raw": LOADS_RAW,
    "clean": repaired("loads"),
    "cleaned": repaired("loads_raw", distinct=True),
    "features": FEATURES,
}
_NEEDS = {
    "loads": ["loads"],
    "loads_raw": ["loads", "loads_raw"],
    "clean": ["loads", "clean"],
    "cleaned": ["loads", "loads_raw", "cleaned"],
    "features": ["loads", "clean", "features"],
}


def over(source: str, body: str, *more: tuple[str, str]) -> str:
    """``body`` with the tables it needs (``source`` and what that is built from) as CTEs."""
    parts = [(name, _CTES[name]) for name in _NEEDS[source]] + list(more)
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts) + "\n" + body


def union(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)
