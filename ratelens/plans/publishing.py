"""File, scenario and contract queries (IO-1 .. IO-6, SC-1 .. SC-6, VA-1 .. VA-15)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ratelens.models.baseline import MeanRegressor
from ratelens.models.evaluation import final_fit, load_model
from ratelens.models.preparation import labelled, rate_model
from ratelens.operators import contract as c
from ratelens.operators import scenario as sc
from ratelens.operators.splits import holdout
from ratelens.plans.common import CUT, PUBLISHED, Query, clean, features, rounded, rounded_mean, rounded_mean_sql
from ratelens.plans.sql import over, union
from ratelens.sources import files
from ratelens.sources.schemas import LOAD_TYPES, PREDICTION, SCENARIO_COLUMNS
from ratelens.sources.shipments import loads, place_coords, table


def _csv_round_trip(spark, folder):
    """Raw loads written as CSV and scanned back with declared types."""
    path = files.scratch_path(spark, "loads-csv")
    files.write_csv(loads(spark, folder), path)
    return rounded(files.read_csv(spark, path, "loads"), 6)


_CSV_SQL = over(
    "loads",
    """SELECT load_id, pickup, delivery, pickup_lat, pickup_lon, delivery_lat, delivery_lon, distance, equipment,
    weight, try_cast(date AS DATE) AS date, round(market_index, 6) AS market_index,
    round(quote_signal, 6) AS quote_signal, round(posted_rate, 6) AS posted_rate FROM loads""",
)


def _parquet_round_trip(spark, folder):
    """Clean loads handed over as Parquet partitioned by month and read back."""
    path = files.scratch_path(spark, "loads-parquet")
    dated = clean(spark, folder).withColumn("month", F.date_format("date", "yyyy-MM"))
    files.write_parquet(dated, path, ["month"])
    back = files.read_parquet(spark, path, "clean loads")
    return rounded(back.select("load_id", "date", "month", "posted_rate"), 6)


def _missing_tokens(spark, folder):
    """Missing-value texts planted in place of supplier states become NULL on scan."""
    path = files.scratch_path(spark, "tokens-csv")
    orders = table(spark, folder, "orders")
    planted = orders.select(
        F.col("o_orderkey").cast("string").alias("load_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "N/A")
        .when(F.col("o_orderpriority") == "2-HIGH", "null")
        .otherwise(F.col("o_orderpriority"))
        .alias("equipment"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "NaN")
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("weight"),
    )
    files.write_csv(planted, path)
    return files.read_csv(spark, path, "tokens", LOAD_TYPES)


_TOKENS_SQL = """SELECT cast(o_orderkey AS VARCHAR) AS load_id,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL ELSE o_orderpriority END AS equipment,
 CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE cast(o_custkey AS DOUBLE) END AS weight FROM orders"""


def _planted_csv(spark, folder):
    """Loads as CSV texts: whole miles, and a weight in words where no equipment is known."""
    path = files.scratch_path(spark, "typed-csv")
    rows = loads(spark, folder).select(
        "load_id", F.floor("distance").alias("miles"), "distance",
        F.when(F.col("equipment").isNull(), "heavy").otherwise(F.col("weight").cast("string")).alias("weight"), "date", "posted_rate",
    )
    files.write_csv(rows, path)
    return path


def _discovered(spark, folder):
    raw = files.read_csv(spark, _planted_csv(spark, folder), "typed", {})
    return files.column_types(raw).select("column", "type", "present", "missing", "numbers", "dates")


def _discovered_sql() -> str:
    columns = [
        ("load_id", "load_id", "0", "0"), ("miles", "distance", "count(distance)", "0"), ("distance", "distance", "count(distance)", "0"),
        ("weight", "w", "count(weight) FILTER (WHERE equipment IS NOT NULL)", "0"), ("date", "date", "0", "count(try_cast(date AS DATE))"),
        ("posted_rate", "posted_rate", "count(posted_rate)", "0"),
    ]
    rows = [
        f"""SELECT '{name}' AS "column", CASE WHEN numbers = present AND '{name}' = 'miles' THEN 'integer' WHEN numbers = present THEN 'double'
        WHEN dates = present THEN 'date' ELSE 'text' END AS type, present, missing, numbers, dates
        FROM (SELECT count({c}) AS present, count(*) - count({c}) AS missing, {n} AS numbers, {d} AS dates FROM planted) t"""
        for name, c, n, d in columns
    ]
    planted = "SELECT *, CASE WHEN equipment IS NULL THEN 'heavy' ELSE cast(weight AS VARCHAR) END AS w FROM loads"
    return over("loads", union(rows), ("planted", planted))


def _widened(spark, folder):
    return files.widened_columns(files.read_csv(spark, _planted_csv(spark, folder), "typed", {}))


def _published(spark, folder):
    """Fixed-column rewrite: projected CSV written to a new path and read back."""
    path = files.scratch_path(spark, "published-csv")
    table_ = clean(spark, folder).withColumn(PREDICTION, F.col("distance") * 2.5)
    files.write_csv(table_, path, SCENARIO_COLUMNS)
    return files.read_csv(spark, path, "published")


_PUBLISHED_SQL = over(
    "clean",
    """SELECT pickup, delivery, distance, equipment, weight, date, distance * 2.5 AS predicted_rate FROM clean""",
)


def _lanes(spark, folder):
    """Every pickup and delivery pair with its typical shipment."""
    return (
        clean(spark, folder)
        .groupBy("pickup", "delivery")
        .agg(
            F.max("distance").alias("distance"),
            F.max("equipment").alias("equipment"),
            F.max("weight").alias("weight"),
        )
    )


_LANES = (
    "lanes",
    """SELECT pickup, delivery, max(distance) AS distance, max(equipment) AS equipment, max(weight) AS weight
    FROM clean GROUP BY 1, 2""",
)
_START, _END = date(2001, 12, 1), date(2001, 12, 31)
_DAYS = "(SELECT unnest(generate_series(DATE '2001-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS day) g"


def _grid(spark, folder):
    return sc.scenario_grid(_lanes(spark, folder), _START, _END)


def _located(spark, folder):
    return sc.attach_coordinates(_grid(spark, folder), place_coords(spark, folder))


def _calendar(spark, folder):
    bounds = clean(spark, folder).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return sc.daily_calendar(bounds, "first", "last")


def scenario_scores(spark, folder):
    """Baseline model on every lane and day: coordinates, defaults, features, model, floor."""
    train, _ = holdout(features(spark, folder), CUT)
    model = rate_model(train, MeanRegressor()).fit(labelled(train))
    return sc.score_scenario(_grid(spark, folder), model, place_coords(spark, folder))


def tree_scenario(spark, folder):
    """The published forest, fitted before the cut, saved, loaded again and applied to every lane and day."""
    train, _ = holdout(features(spark, folder), CUT)
    path = files.scratch_path(spark, "scenario-model")
    final_fit(train, path, **PUBLISHED)
    scored = sc.score_scenario(_grid(spark, folder), load_model(spark, path), place_coords(spark, folder))
    return rounded(scored.select("pickup", "delivery", "date", PREDICTION), 6)


_SCENARIO = (
    "scenario",
    f"""SELECT pickup, delivery, distance, equipment, weight, cast(day AS DATE) AS date,
    (SELECT avg(posted_rate) FROM clean WHERE date < DATE '{CUT}') AS predicted_rate
    FROM lanes CROSS JOIN {_DAYS}""",
)


def _predictions(spark, folder):
    """Submission-shaped table from orders: some keys repeated, some malformed, some rates bad."""
    orders = table(spark, folder, "orders")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    key = F.format_string("TE-%06d", F.col("o_orderkey"))
    copies = F.when((priority == "1-URGENT") & (status == "P"), F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    rate = F.col("o_totalprice").cast("string")
    return orders.withColumn("copy", F.explode(copies)).select(
        F.when((priority == "2-HIGH") & (status == "P"), F.concat(F.lit("X"), key))
        .when((priority == "3-MEDIUM") & (status == "P"), F.lit(None))
        .otherwise(key)
        .alias("load_id"),
        F.when((priority == "5-LOW") & (status == "O"), "n/a")
        .when((priority == "5-LOW") & (status == "F"), "-1")
        .otherwise(rate)
        .alias(PREDICTION),
    )


_SUBMITTED = (
    "submitted",
    """SELECT CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN concat('X', k)
      WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN NULL ELSE k END AS load_id,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN NULL
      WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN -1 ELSE o_totalprice END AS p
    FROM (SELECT *, concat('TE-', lpad(cast(o_orderkey AS VARCHAR), 6, '0')) AS k FROM orders) o,
    LATERAL (SELECT unnest(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
      THEN [1, 2] ELSE [1] END) AS copy) x""",
)


def _expected(spark, folder):
    return table(spark, folder, "orders").select(F.format_string("TE-%06d", "o_orderkey").alias("load_id")).distinct()


def _prediction_rules(spark, folder):
    report = c.check_predictions(_predictions(spark, folder), _expected(spark, folder))
    return report.select("position", "rule", "violations", "passed")


_PREDICTION_RULES = [
    ("columns", "cast(0 AS BIGINT)"),
    ("row_count", "(SELECT abs(count(*) - 12000) FROM submitted)"),
    ("missing_keys", "(SELECT count(*) FROM submitted WHERE load_id IS NULL)"),
    ("duplicate_keys", "(SELECT count(load_id) - count(DISTINCT load_id) FROM submitted)"),
    ("keys_not_submitted", "(SELECT count(*) FROM (SELECT k FROM expected EXCEPT SELECT load_id FROM submitted) a)"),
    (
        "keys_not_expected",
        """(SELECT count(*) FROM (SELECT load_id FROM submitted WHERE load_id IS NOT NULL
        EXCEPT SELECT k FROM expected) b)""",
    ),
    ("not_finite", "(SELECT count(*) FROM submitted WHERE p IS NULL)"),
    ("not_positive", "(SELECT count(*) FROM submitted WHERE p <= 0)"),
]
_EXPECTED = ("expected", "SELECT DISTINCT concat('TE-', lpad(cast(o_orderkey AS VARCHAR), 6, '0')) AS k FROM orders")


def _rules_sql(rules: list[tuple[str, str]]) -> str:
    rows = [
        f"SELECT {i} AS position, '{name}' AS rule, {count} AS violations" for i, (name, count) in enumerate(rules, 1)
    ]
    return f"SELECT *, violations = 0 AS passed FROM ({union(rows)}) r"


def _prediction_rules_sql(rules=_PREDICTION_RULES) -> str:
    parts = ",\n".join(f"{n} AS ({t})" for n, t in (_SUBMITTED, _EXPECTED))
    return f"WITH {parts}\n{_rules_sql(rules)}"


_LANE = c.Lane(
    pickup="NATION_1", delivery="NATION_2", distance=3125.0, equipment="Reefer", weight=50_000.0,
    start=date(2001, 9, 1), end=date(2001, 10, 31),
)


def _scenario_table(spark, folder, undated=False):
    """Scenario-shaped table: one row per load of the lane's end place, real dates and sizes; undated loads on request."""
    late = F.col("date") >= F.lit(_LANE.start)
    return (
        clean(spark, folder)
        .where(late | F.col("date").isNull() if undated else late)
        .withColumn(PREDICTION, F.col("posted_rate") - 1000.0)
        .select(*SCENARIO_COLUMNS)
    )


def _scenario_rules(spark, folder):
    return c.check_scenario(_scenario_table(spark, folder), _LANE).select(
        "position", "rule", "violations", "passed"
    )


def _scenario_rules_sql(undated=False) -> str:
    days = (_LANE.end - _LANE.start).days + 1
    period = f"date BETWEEN DATE '{_LANE.start}' AND DATE '{_LANE.end}'"

    def broken(test: str) -> str:
        return f"(SELECT count(*) FROM t WHERE NOT coalesce({test}, false))"

    rules = [
        ("columns", f"cast({int(undated)} AS BIGINT)"),
        ("invalid_dates", "(SELECT count(*) FROM t WHERE date IS NULL)"),
        ("distance_not_finite", "(SELECT count(*) FROM t WHERE distance IS NULL)"),
        ("weight_not_finite", "(SELECT count(*) FROM t WHERE weight IS NULL)"),
        ("prediction_not_finite", "(SELECT count(*) FROM t WHERE p IS NULL)"),
        ("duplicate_dates", "(SELECT count(date) - count(DISTINCT date) FROM t)"),
        ("row_count", f"(SELECT abs(count(*) - {days}) FROM t)"),
        ("days_missing", f"(SELECT {days} - count(DISTINCT date) FROM t WHERE {period})"),
        ("days_extra", f"(SELECT count(DISTINCT date) FROM t WHERE NOT {period})"),
        ("pickup", broken(f"pickup = '{_LANE.pickup}'")),
        ("delivery", broken(f"delivery = '{_LANE.delivery}'")),
        ("distance", broken(f"abs(distance - {_LANE.distance}) <= 1e-8 + 1e-5 * {_LANE.distance}")),
        ("equipment", broken(f"equipment = '{_LANE.equipment}'")),
        ("weight", broken(f"abs(weight - {_LANE.weight}) <= 1e-8 + 1e-5 * {_LANE.weight}")),
        ("not_positive", "(SELECT count(*) FROM t WHERE p <= 0)"),
    ]
    return over(
        "clean",
        _rules_sql(rules),
        (
            "t",
            f"""SELECT *, posted_rate - 1000 AS p FROM clean
            WHERE date >= DATE '{_LANE.start}'{' OR date IS NULL' if undated else ''}""",
        ),
    )


def _chart(spark, folder):
    """Daily mean rate as the chart source."""
    daily = clean(spark, folder).where(F.col("date").isNotNull()).groupBy("date").agg(F.avg("posted_rate").alias(PREDICTION))
    return rounded(rounded_mean(sc.chart_rows(daily), PREDICTION), 6)


_CHART_SQL = over(
    "clean",
    f"""SELECT date, {rounded_mean_sql("p")} AS predicted_rate,
    round((SELECT min(p) - greatest(10, min(p) * 0.02) FROM daily), 6) AS baseline FROM daily ORDER BY date""",
    ("daily", "SELECT date, avg(posted_rate) AS p FROM clean WHERE date IS NOT NULL GROUP BY 1"),
)

QUERIES = {
    "io1_2_4_csv_round_trip": Query(_csv_round_trip, _CSV_SQL),
    "io1_missing_value_texts": Query(_missing_tokens, _TOKENS_SQL),
    "io3_4_parquet_round_trip": Query(
        _parquet_round_trip,
        over(
            "clean",
            """SELECT load_id, date, strftime(date, '%Y-%m') AS month, round(posted_rate, 6) AS posted_rate
            FROM clean""",
        ),
    ),
    "io1_discovered_types": Query(_discovered, _discovered_sql()),
    "io1_widened_columns": Query(
        _widened,
        over(
            "loads",
            """SELECT 'weight' AS "column", 'double' AS declared, 'text' AS type, count(*) AS lost FROM loads WHERE equipment IS NULL
            HAVING count(*) > 0
            UNION ALL SELECT 'date', 'date', 'text', count(date) - count(try_cast(date AS DATE)) FROM loads
            HAVING count(date) > count(try_cast(date AS DATE))""",
        ),
    ),
    "io3_scan_report": Query(
        lambda s, d: files.scan_report(s, {n: f"{d}/{n}.parquet" for n in ("orders", "lineitem", "absent")}),
        """SELECT 'orders' AS label, true AS readable, count(*) AS rows FROM orders
        UNION ALL SELECT 'lineitem', true, count(*) FROM lineitem UNION ALL SELECT 'absent', false, NULL""",
    ),
    "io6_published_columns": Query(_published, _PUBLISHED_SQL),
    "sc1_daily_calendar": Query(
        _calendar,
        over(
            "clean",
            """SELECT cast(unnest(generate_series((SELECT min(date) FROM clean), (SELECT max(date) FROM clean),
            INTERVAL 1 DAY)) AS DATE) AS date""",
        ),
    ),
    "sc2_scenario_grid": Query(
        _grid,
        over(
            "clean",
            f"""SELECT pickup, delivery, distance, equipment, weight, cast(day AS DATE) AS date
            FROM lanes CROSS JOIN {_DAYS}""",
            _LANES,
        ),
    ),
    "sc3_coordinates": Query(
        lambda s, d: _located(s, d).select(
            "pickup", "delivery", "date", "pickup_lat", "pickup_lon", "delivery_lat", "delivery_lon"
        ),
        over(
            "clean",
            f"""SELECT pickup, delivery, cast(day AS DATE) AS date,
            25e0 + (a.n_nationkey * 7) % 24 AS pickup_lat, -122e0 + (a.n_nationkey * 11) % 50 AS pickup_lon,
            25e0 + (b.n_nationkey * 7) % 24 AS delivery_lat, -122e0 + (b.n_nationkey * 11) % 50 AS delivery_lon
            FROM lanes JOIN nation a ON a.n_name = pickup JOIN nation b ON b.n_name = delivery CROSS JOIN {_DAYS}""",
            _LANES,
        ),
    ),
    "sc4_neutral_inputs": Query(
        lambda s, d: sc.neutral_inputs(_grid(s, d)).select("pickup", "delivery", "date", "market_index", "quote_signal"),
        over(
            "clean",
            f"""SELECT pickup, delivery, cast(day AS DATE) AS date, 1e0 AS market_index, 0e0 AS quote_signal
            FROM lanes CROSS JOIN {_DAYS}""",
            _LANES,
        ),
    ),
    "sc5_scenario_scores": Query(
        lambda s, d: rounded(scenario_scores(s, d).select("pickup", "delivery", "date", PREDICTION), 6),
        over(
            "clean",
            "SELECT pickup, delivery, date, round(predicted_rate, 6) AS predicted_rate FROM scenario",
            _LANES,
            _SCENARIO,
        ),
    ),
    "sc5_tree_scenario": Query(tree_scenario),
    "sc6_publish": Query(
        lambda s, d: rounded(sc.publish(_grid(s, d).withColumn(PREDICTION, F.col("distance") * 2.5)), 6),
        over(
            "clean",
            f"""SELECT pickup, delivery, distance, equipment, weight, cast(day AS DATE) AS date,
            distance * 2.5 AS predicted_rate FROM lanes CROSS JOIN {_DAYS} ORDER BY day""",
            _LANES,
        ),
    ),
    "va1_6_prediction_rules": Query(_prediction_rules, _prediction_rules_sql()),
    "va1_planted_columns": Query(
        lambda s, d: c.check_predictions(_predictions(s, d).select(PREDICTION, "load_id"), _expected(s, d)).select(
            "position", "rule", "violations", "passed"
        ),
        _prediction_rules_sql([("columns", "cast(1 AS BIGINT)"), *_PREDICTION_RULES[1:]]),
    ),
    "va4_key_set": Query(
        lambda s, d: c.expected_keys(s, 12_000)
        .join(_predictions(s, d).select("load_id"), "load_id", "left_anti"),
        "WITH " + f"submitted AS ({_SUBMITTED[1]})" + """
        SELECT concat('TE-', lpad(cast(i AS VARCHAR), 6, '0')) AS load_id FROM range(1, 12001) r(i)
        WHERE concat('TE-', lpad(cast(i AS VARCHAR), 6, '0')) NOT IN
          (SELECT load_id FROM submitted WHERE load_id IS NOT NULL)""",
    ),
    "va7_14_scenario_rules": Query(_scenario_rules, _scenario_rules_sql()),
    "va7_8_planted_columns_and_dates": Query(
        lambda s, d: c.check_scenario(_scenario_table(s, d, undated=True).select(*reversed(SCENARIO_COLUMNS)), _LANE).select(
            "position", "rule", "violations", "passed"
        ),
        _scenario_rules_sql(undated=True),
    ),
    "va15_chart_rows": Query(_chart, _CHART_SQL),
}
