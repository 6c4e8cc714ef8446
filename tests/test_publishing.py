"""Scenario grids and contract rules: one valid and one broken frame per rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratelens.errors import ContractError
from ratelens.operators import contract as c
from ratelens.operators import metrics as m
from ratelens.operators import scenario as sc
from ratelens.operators.splits import assign_folds, monthly_folds

# Predictions of the published scenario table, one per day of December 2025.
PUBLISHED = [
    857.1869500000003, 865.6251055555559, 865.3938000000003, 865.096327777778, 864.8398833333337, 861.1682333333334,
    862.9853444444445, 865.6859388888893, 865.6859388888893, 865.3336833333336, 865.160366666667, 864.8895055555558,
    861.2466944444446, 862.9083500000002, 865.5941333333336, 865.712416666667, 865.5070444444448, 865.1541333333334,
    864.9425944444447, 861.4434555555558, 863.4828277777781, 866.3628888888894, 866.4166722222227, 866.3294666666671,
    866.0319944444448, 865.6513222222227, 861.7943277777781, 863.6114388888892, 850.5662722222223, 850.5662722222223,
    850.2536944444446,
]
SCENARIO = "pickup string, delivery string, distance double, equipment string, weight double, date string, predicted_rate string"


def scenario_rows(spark, change=lambda i, row: row):
    rows = []
    for i, rate in enumerate(PUBLISHED):
        row = ["Lexington", "Fort Wayne", 360.0, "Dry Van", 32000.0, f"2025-12-{i + 1:02d}", str(rate)]
        rows.append(tuple(change(i, row)))
    return spark.createDataFrame(rows, SCENARIO)


def failed(report):
    return [r["rule"] for r in report.orderBy("position").collect() if not r["passed"]]


def test_published_scenario_passes(spark):
    report = c.check_scenario(scenario_rows(spark))
    assert failed(report) == []
    c.assert_contract(report)


@pytest.mark.parametrize(
    "column, value, rules",
    [
        (5, "soon", ["invalid_dates", "days_missing"]),
        (2, None, ["distance_not_finite", "distance"]),
        (4, float("inf"), ["weight_not_finite", "weight"]),
        (6, "abc", ["prediction_not_finite"]),
        (6, "-3", ["not_positive"]),
        (5, "2025-12-02", ["duplicate_dates", "days_missing"]),
        (5, "2026-01-01", ["days_missing", "days_extra"]),
        (0, None, ["pickup"]),
        (1, "Elsewhere", ["delivery"]),
        (2, 360.1, ["distance"]),
        (3, "Reefer", ["equipment"]),
        (4, 31_999.0, ["weight"]),
    ],
)
def test_every_scenario_rule_can_fail(spark, column, value, rules):
    def change(i, row):
        if i == 4:
            row[column] = value
        return row

    report = c.check_scenario(scenario_rows(spark, change))
    assert failed(report) == rules
    with pytest.raises(ContractError):
        c.assert_contract(report)


def test_close_constants_pass_and_columns_are_checked_in_order(spark):
    close = scenario_rows(spark, lambda i, row: [*row[:2], 360.0001, *row[3:]])
    assert failed(c.check_scenario(close)) == []
    assert failed(c.check_scenario(close.select("delivery", "pickup", *close.columns[2:]))) == ["columns"]
    assert failed(c.check_scenario(close.where("date <> '2025-12-31'"))) == ["row_count", "days_missing"]


def predictions(spark, n=6, change=lambda rows: rows):
    rows = [(f"TE-{i:06d}", "10.5") for i in range(1, n + 1)]
    return spark.createDataFrame(change(rows), "load_id string, predicted_rate string")


@pytest.mark.parametrize(
    "change, rules",
    [
        (lambda r: r, []),
        (lambda r: r[:-1], ["row_count", "keys_not_submitted"]),
        (lambda r: r[:-1] + [(None, "1")], ["missing_keys", "keys_not_submitted"]),
        (lambda r: r[:-1] + [r[0]], ["duplicate_keys", "keys_not_submitted"]),
        (lambda r: r[:-1] + [("TE-999999", "1")], ["keys_not_submitted", "keys_not_expected"]),
        (lambda r: r[:-1] + [(r[-1][0], "NaN")], ["not_finite"]),
        (lambda r: r[:-1] + [(r[-1][0], "Infinity")], ["not_finite"]),
        (lambda r: r[:-1] + [(r[-1][0], None)], ["not_finite"]),
        (lambda r: r[:-1] + [(r[-1][0], "0")], ["not_positive"]),
    ],
)
def test_every_prediction_rule_can_fail(spark, change, rules):
    report = c.check_predictions(predictions(spark, change=change), c.expected_keys(spark, 6), 6)
    assert failed(report) == rules


def test_prediction_columns_are_checked(spark):
    df = predictions(spark).select("predicted_rate", "load_id")
    assert failed(c.check_predictions(df, c.expected_keys(spark, 6), 6)) == ["columns"]


def test_scenario_grid_is_lanes_times_days_without_a_join(spark):
    lanes = spark.createDataFrame([("A", "B"), ("C", "D")], "pickup string, delivery string")
    grid = sc.scenario_grid(lanes, dt.date(2025, 12, 1), dt.date(2025, 12, 31))
    assert grid.count() == 62
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()


def test_unknown_place_fails(spark):
    places = spark.createDataFrame(sc.KNOWN_PLACES, "place string, lat double, lon double")
    good = spark.createDataFrame([("Lexington", "Fort Wayne")], "pickup string, delivery string")
    row = sc.attach_coordinates(good, places).first()
    assert (row["pickup_lat"], row["delivery_lon"]) == (37.9887, -85.1394)
    bad = spark.createDataFrame([("Lexington", "Atlantis")], "pickup string, delivery string")
    with pytest.raises(Exception, match="unknown place: Atlantis"):
        sc.attach_coordinates(bad, places).collect()


def test_chart_baseline(spark):
    df = scenario_rows(spark).withColumn("predicted_rate", F.col("predicted_rate").cast("double"))
    got = sc.chart_rows(df).collect()
    lowest = min(PUBLISHED)
    assert got[0]["baseline"] == pytest.approx(lowest - max(10.0, lowest * 0.02)) and len(got) == 31


def test_fold_summary_reproduces_the_published_means(spark):
    folds = [
        ("June → July", 145.86809656985156, 672.3295859085929, 0.8003760722099014),
        ("July → August", 178.35943589129369, 685.4067667329093, 0.7840187887804386),
        ("August → September", 140.0039661175351, 654.7048617423028, 0.8152823676695035),
        ("September → October", 152.71043550095015, 703.2007664458965, 0.7883610187358799),
    ]
    row = m.fold_summary(spark.createDataFrame(folds, "fold string, MAE double, RMSE double, R2 double")).first()
    assert (round(row["mean_MAE"], 2), round(row["mean_RMSE"], 2), round(row["mean_R2"], 4)) == (154.24, 678.91, 0.7970)
    assert [f.name for f in monthly_folds()] == [f[0] for f in folds]


def test_r_squared_without_spread(spark):
    df = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 2.0), ("b", 2.0, 1.0), ("b", 2.0, 2.0), ("c", 1.0, 1.0)], "g string, posted_rate double, predicted_rate double")
    got = {r["g"]: r["R2"] for r in m.regression_metrics(df, ["g"]).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": None}


def test_training_rows_always_precede_validation_rows(spark):
    days = spark.createDataFrame([(dt.date(2025, 1, 1) + dt.timedelta(days=i),) for i in range(330)], "date date")
    got = assign_folds(days, monthly_folds()).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("date"))).alias("last"),
        F.min(F.when(F.col("role") == "valid", F.col("date"))).alias("first"),
        F.count_if(F.col("role") == "valid").alias("n"),
    )
    rows = got.collect()
    assert len(rows) == 4 and all(r["last"] < r["first"] for r in rows) and sorted(r["n"] for r in rows) == [30, 31, 31, 31]
