"""Exact quantiles against numpy, including many narrowing passes."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.functions import quantiles as q
from ratelens.functions.quantiles import column_quantile, quantiles

PROBS = {"p00": 0.0, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}


def check(row, data):
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(data, p), rel=1e-12, abs=1e-12), name


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: v + 0.0), min_size=1, max_size=40))
def test_small_columns(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "v double")
    check(quantiles(df, "v", PROBS).first(), data)


@pytest.mark.parametrize("accuracy", [40, 200])
@pytest.mark.parametrize("shape", ["distinct", "repeated", "skewed"])
def test_narrow_brackets_still_give_exact_ranks(spark, accuracy, shape):
    rng = np.random.default_rng(7)
    data = {
        "distinct": rng.normal(size=6000),
        "repeated": rng.integers(0, 9, size=6000).astype(float),
        "skewed": np.exp(rng.normal(size=6000) * 6),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in data], "v double").repartition(5)
    check(quantiles(df, "v", PROBS, accuracy=accuracy).first(), data)


def test_groups_with_one_hot_key_missing_values_and_missing_keys(spark):
    rng = np.random.default_rng(3)
    keys = ["hot" if i % 3 == 0 else f"k{i % 50}" for i in range(3000)]
    values = [None if i % 11 == 0 else float(v) for i, v in enumerate(rng.gamma(2.0, size=3000))]
    rows = list(zip(keys, values)) + [("empty", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = quantiles(df, "v", PROBS, by=["k"], aggregates=[F.count("v").alias("n")], accuracy=100).collect()
    assert {r["k"] for r in got} == set(keys) | {"empty"}
    for r in got:
        data = [v for k, v in rows if k == r["k"] and v is not None]
        assert r["n"] == len(data)
        if data:
            check(r, data)
        else:
            assert r["p50"] is None


def test_approximate_quantiles_keep_their_rank_error(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    row = quantiles(df, "v", {"m": 0.5}, exact=False, accuracy=100, aggregates=[F.count("v").alias("n")]).first()
    assert row["n"] == 10_001 and abs(row["m"] - 5_000) <= 110
    assert len(quantiles(df, "v", {"m": 0.5}, by=["k"], exact=False).collect()) == 2


def test_empty_column_is_missing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles(df, "v", {"m": 0.5}).first()["m"] is None


def test_extreme_values_and_infinitesimal_steps(spark):
    data = [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, 1.0, 1.0 + 2**-52, 1.0, -1e300] * 7
    df = spark.createDataFrame([(v,) for v in data], "v double")
    row = quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 1.0}, accuracy=3).first()
    assert (row["a"], row["b"], row["c"]) == (min(data), float(np.quantile(data, 0.5)), max(data))


def test_windows_see_sub_ranges_or_few_values(spark):
    """No exchange gathers values in one partition: a narrowing pass ends in one row per task and sub-range."""
    from ratelens.functions import quantiles as module

    df = spark.range(100_000).select(F.col("id").cast("double").alias("__value"), F.lit(0).alias("__all"))
    ranks = F.array(F.lit(50_000).cast("long"), F.lit(50_001).cast("long"))
    start = df.groupBy("__all").agg(F.min("__value").alias("lo"), F.max("__value").alias("hi"), F.count("__value").alias("inside"))
    spark.sparkContext.getCheckpointDir()
    brackets = start.select("*", F.lit(0).cast("long").alias("skip"), ranks.alias("ranks"))
    cut = module._narrowed(df, brackets, ["__all"], 100).collect()
    assert sum(r["inside"] for r in cut) <= 2_000
    for r in cut:
        assert all(r["skip"] < k <= r["skip"] + r["inside"] for k in r["ranks"])
    assert sorted(k for r in cut for k in r["ranks"]) == [50_000, 50_001]


@pytest.mark.parametrize("sample", [1, 40, 1 << 18])
def test_quantiles_of_columns_are_exact_whatever_the_sample_proposes(spark, sample):
    rng = np.random.default_rng(7)
    data = {
        "normal": rng.normal(size=3000), "flags": (rng.random(3000) < 0.5) * 1.0, "flat": np.full(3000, -2.5), "steps": np.floor(rng.random(3000) * 5),
        "far": rng.standard_cauchy(3000) * 1e200, "half": np.repeat([1.0, 2.0], 1500), "a.b": np.arange(3000) * 1.0,
    }
    gaps = {c: [None if c == "normal" and i % 3 == 0 else float(v) for i, v in enumerate(vs)] for c, vs in data.items()}
    df = spark.createDataFrame(list(zip(*gaps.values(), [None] * 3000)), ", ".join(f"`{c}` double" for c in [*gaps, "none"]))
    for p in (0.0, 0.01, 0.5, 1.0):
        got = {r["column"]: r["value"] for r in column_quantile(df, df.columns, p, sample=sample).collect()}
        assert got.pop("none") is None
        assert got == {c: pytest.approx(np.quantile([v for v in vs if v is not None], p), rel=1e-12) for c, vs in gaps.items()}
    assert column_quantile(df.where("1 = 0"), df.columns, 0.5).count() == 0


def test_medians_of_columns_narrow_only_the_few_rows_near_them(spark, monkeypatch):
    seen = []
    settled = q._settled
    monkeypatch.setattr(q, "_settled", lambda values, *rest: seen.append(values.count()) or settled(values, *rest))
    df = spark.range(20_000).select(*[(F.xxhash64("id", F.lit(i)) / 1e12).alias(f"v{i}") for i in range(3)])
    column_quantile(df, df.columns, 0.5, sample=5_000)
    assert sum(seen) < 6_000  # of 60,000 values
