"""Row expressions: the semantic traps, each on a few rows."""

import math

import pytest
from pyspark.sql import functions as F

from ratelens.functions import columns as c
from ratelens.operators.features import DISTANCE_EDGES, DISTANCE_LABELS, create_features

NAN, INF = float("nan"), float("inf")


def values(spark, data, expression, kind="double"):
    rows = [(i, v) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_removes_unicode_whitespace_and_keeps_inner_text(spark):
    data = ["  a b\t", "　x ", "\x1cy\n", "plain", None, "   "]
    expected = [None if v is None else v.strip() for v in data]
    assert values(spark, data, c.strip, "string") == expected


def test_clip_keeps_missing(spark):
    assert values(spark, [-1.0, None, 2.0], lambda v: c.at_least(v, 0.0)) == [0.0, None, 2.0]


def test_finite_drops_nan_and_both_infinities(spark):
    assert values(spark, [1.0, NAN, INF, -INF, None], c.finite) == [1.0, None, None, None, None]


def test_buckets_are_right_closed(spark):
    data = [250.0, 250.01, 500.0, 2500.0, 2500.5, -5.0, -INF, INF, NAN, None]
    got = values(spark, data, lambda v: c.labelled_bucket(v, DISTANCE_EDGES, DISTANCE_LABELS))
    assert got == [
        "very_short", "short", "short", "very_long", "extreme", "very_short", None, "extreme", None, None,
    ]


def test_last_bin_is_closed_and_constant_range_is_widened(spark):
    got = values(spark, [0.0, 1.9, 2.0, 10.0], lambda v: c.equal_width_bin(v, F.lit(0.0), F.lit(10.0), 5))
    assert got == [0, 0, 1, 4]
    assert values(spark, [3.0], lambda v: c.equal_width_bin(v, F.lit(3.0), F.lit(3.0), 5)) == [2]


def test_ratio_by_zero_is_missing(spark):
    assert values(spark, [0.0, 2.0, None, -0.0], lambda v: c.safe_ratio(F.lit(4.0), v)) == [None, 2.0, None, None]


def _load(**changes):
    row = {
        "load_id": "L1", "pickup": "A", "delivery": "B", "pickup_lat": 37.9887, "pickup_lon": -84.4777,
        "delivery_lat": 41.0793, "delivery_lon": -85.1394, "distance": 360.0, "equipment": "Dry Van",
        "weight": 32000.0, "date": "2024-12-30", "market_index": 1.1, "quote_signal": 2.5, "posted_rate": 900.0,
    }
    return {**row, **changes}


SCHEMA = (
    "load_id string, pickup string, delivery string, pickup_lat double, pickup_lon double, delivery_lat double, "
    "delivery_lon double, distance double, equipment string, weight double, date string, market_index double, "
    "quote_signal double, posted_rate double"
)


def features_of(spark, *rows):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    return [r.asDict() for r in create_features(df).collect()]


def test_feature_values(spark):
    (f,) = features_of(spark, _load())
    assert (f["year"], f["month"], f["day"], f["day_of_week"], f["week_of_year"]) == (2024, 12, 30, 0, 1.0)
    assert (f["is_weekend"], f["is_month_start"], f["is_month_end"]) == (0, 0, 0)
    assert f["route"] == "A -> B" and f["distance_bucket"] == "short" and f["weight_bucket"] == "heavy"
    lat1, lon1, lat2, lon2 = map(math.radians, (37.9887, -84.4777, 41.0793, -85.1394))
    a = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    assert f["geo_distance"] == pytest.approx(2 * 3958.8 * math.asin(math.sqrt(a)), rel=1e-12)
    assert f["log_distance"] == pytest.approx(math.log1p(360))
    assert f["quote_signal_deviation"] == 0.5 and f["quote_signal_squared"] == 6.25
    assert f["weight_per_distance"] == pytest.approx(32000 / 360)
    assert len(f) == 14 + 26


def test_missing_date_keeps_flags_at_zero_and_missing_place_is_spelled_out(spark):
    (f,) = features_of(spark, _load(date="junk", pickup=None, distance=0.0, weight=None))
    assert f["date"] is None and f["year"] is None
    assert (f["is_weekend"], f["is_month_start"], f["is_month_end"]) == (0, 0, 0)
    assert f["route"] == "nan -> B"
    assert f["weight_per_distance"] is None and f["log_weight"] is None and f["weight_bucket"] is None


def test_infinite_inputs_become_missing_everywhere(spark):
    (f,) = features_of(spark, _load(distance=INF, weight=-INF, pickup_lat=INF, market_index=NAN))
    assert f["distance"] is None and f["log_distance"] is None and f["distance_bucket"] == "extreme"
    assert f["weight"] is None and f["weight_bucket"] is None and f["log_weight"] == 0.0
    assert f["lat_diff"] is None and f["geo_distance"] is None and f["distance_x_weight"] is None
    assert f["market_index"] is None and f["distance_x_market"] is None


def test_features_do_not_depend_on_the_target(spark):
    a, b = features_of(spark, _load(), _load(posted_rate=-1e9))
    assert {k: v for k, v in a.items() if k != "posted_rate"} == {k: v for k, v in b.items() if k != "posted_rate"}


def test_features_need_no_shuffle(spark):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(_load()[n] for n in names)], SCHEMA)
    plan = create_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
