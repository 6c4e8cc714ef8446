"""Cleaning rules, quality reports and distribution statistics on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from ratelens.errors import ContractError
from ratelens.operators import cleaning, distribution, explore, quality
from ratelens.sources import files
from ratelens.sources.shipments import loads, loads_raw


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_clean_strips_before_it_removes_copies(spark, folder):
    raw, base = loads_raw(spark, folder), loads(spark, folder)
    cleaned = cleaning.clean_loads(raw)
    assert raw.count() > base.count() == cleaned.count()


def test_cleaning_twice_changes_nothing(spark, folder):
    once = cleaning.clean_loads(loads_raw(spark, folder)).cache()
    twice = cleaning.clean_loads(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    once.unpersist()


def test_rules_apply_only_to_present_columns(spark):
    df = spark.createDataFrame([(" a ", -1.0, "2024-02-30"), ("a", 0.0, "2024-02-29")], "x string, weight double, pickup_Date string")
    got = rows_of(cleaning.clean_loads(df), "weight")
    assert got == [("a", None, None), ("a", 0.0, dt.date(2024, 2, 29))]


def test_empty_text_becomes_missing(spark):
    df = spark.createDataFrame([("  ",), ("x",)], "t string")
    assert rows_of(cleaning.clean_loads(df), "t") == [(None,), ("x",)]


def test_quality_report_counts_one_missing_value_as_a_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -0.0), (None, 0.0), (None, None)], "t string, v double")
    got = {r["column"]: r.asDict() for r in quality.quality_report(df).collect()}
    assert (got["t"]["missing"], got["t"]["missing_%"], got["t"]["unique"], got["t"]["duplicate_values"]) == (2, 50.0, 1, 2)
    assert (got["v"]["missing"], got["v"]["unique"], got["v"]["duplicate_values"]) == (1, 2, 1)


def test_quality_report_of_an_empty_table_lists_every_column(spark):
    got = quality.quality_report(spark.createDataFrame([], "a string, b double")).collect()
    assert [(r["column"], r["missing"], r["missing_%"], r["unique"]) for r in got] == [("a", 0, None, 0), ("b", 0, None, 0)]


def test_absent_key_column_is_reported(spark):
    assert quality.key_report(spark.range(3), "load_id").first()["key_present"] is False


def test_category_report_keeps_missing_values_and_cuts_before_the_shuffle(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(f"v{i % 30:02d}",) for i in range(60)], "t string")
    report = quality.category_report(df, top=5)
    got = rows_of(report, "rank")
    assert got[0] == ("t", 30, 1, None, 3) and len(got) == 5
    assert "WindowGroupLimit" in report._jdf.queryExecution().optimizedPlan().toString()


def test_target_guards(spark):
    with pytest.raises(ContractError):
        quality.guard_target(spark.range(2))
    negative = spark.createDataFrame([(-1.0,), (None,)], "posted_rate double")
    with pytest.raises(ContractError):
        quality.guard_target(negative)
    assert quality.guard_target(negative.where("posted_rate is null")) == 1


def test_target_derived_columns_may_not_be_features():
    assert quality.guard_features(["distance", "posted_rate"]) == ["distance"]
    with pytest.raises(ContractError):
        quality.guard_features(["distance", "rate_per_mile"])


def test_correlation_of_a_constant_is_missing_and_pairs_are_complete(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 7.0, None), (2.0, 4.0, 7.0, 1.0), (3.0, 6.5, 7.0, 3.0), (None, 9.0, 7.0, -2.0)],
        "a double, b double, k double, d double",
    )
    got = {(r["column"], r["other"]): r["correlation"] for r in distribution.correlation_matrix(df, ["a", "b", "k", "d"]).collect()}
    assert len(got) == 16 and got[("k", "k")] is None and got[("a", "k")] is None and got[("k", "a")] is None
    import numpy as np

    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1], abs=1e-12)
    assert got[("b", "d")] == pytest.approx(np.corrcoef([4, 6.5, 9], [1, 3, -2])[0, 1], abs=1e-12)
    assert got[("a", "a")] == 1.0


def test_moments_are_sample_corrected(spark):
    import pandas as pd

    data = [1.0, 2.0, 2.5, 9.0, 11.0, 30.0]
    row = distribution.moments(spark.createDataFrame([(v,) for v in data], "v double"), "v").first()
    assert row["skewness"] == pytest.approx(pd.Series(data).skew()) and row["kurtosis"] == pytest.approx(pd.Series(data).kurt())
    flat = distribution.moments(spark.createDataFrame([(3.0,)] * 5, "v double"), "v").first()
    assert flat["skewness"] is None and flat["kurtosis"] is None


def test_histogram_covers_every_value_and_lists_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (10.0,), (None,)], "v double")
    got = distribution.histogram(df, ["v"], 5).orderBy("bin").collect()
    assert [r["count"] for r in got] == [1, 1, 0, 0, 1]
    assert (got[0]["left"], got[-1]["right"]) == (0.0, 10.0)


def test_density_curve_matches_the_formula(spark):
    import numpy as np

    data = np.array([1.0, 1.0, 2.0, 5.0, 9.0])
    got = distribution.density_curve(spark.createDataFrame([(float(v),) for v in data], "v double"), ["v"], 11)
    h = data.std(ddof=1) * len(data) ** -0.2
    for r in got.collect():
        want = np.exp(-0.5 * ((r["x"] - data) / h) ** 2).sum() / (len(data) * h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want, rel=1e-12)


def test_weekdays_without_rows_are_missing_not_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 5.0)], "date date, posted_rate double")
    got = [tuple(r) for r in explore.weekday_profile(df).collect()]
    assert got[0] == ("Monday", 1, 5.0) and got[1:] == [(d, None, None) for d in explore.WEEKDAYS[1:]]


def test_top_routes_equals_the_full_profile(spark, folder):
    table = cleaning.repair_rows(cleaning.strip_text(loads(spark, folder)))
    full = explore.route_profile(table).limit(20).collect()
    assert [r.asDict() for r in explore.top_routes(table, 20).collect()] == [
        pytest.approx(r.asDict()) for r in full
    ]


def test_csv_missing_texts_types_and_whitespace(spark, tmp_path):
    path = tmp_path / "loads.csv"
    path.write_text("load_id,pickup,weight,date,note\nA,NA,NaN,2024-01-05,n/a\nB,  x ,12.5,bad,ok\nC,null,oops,,#N/A\n")
    got = rows_of(files.read_csv(spark, str(path)), "load_id")
    assert got == [
        ("A", None, None, dt.date(2024, 1, 5), None), ("B", "  x ", 12.5, None, "ok"), ("C", None, None, None, None),
    ]
    files.write_csv(files.read_csv(spark, str(path)), str(tmp_path / "out"))
    assert rows_of(files.read_csv(spark, str(tmp_path / "out")), "load_id") == got


def test_unreadable_paths_name_their_label(spark, tmp_path):
    for reader in (files.read_csv, files.read_parquet):
        with pytest.raises(ContractError, match="december scenario"):
            reader(spark, str(tmp_path / "absent"), "december scenario")


def test_one_scan_feeds_the_quality_report(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    plan = quality.rule_violations(df.withColumnRenamed("l_quantity", "weight").select("weight", "l_tax"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" in text and "l_tax" not in text.split("ReadSchema")[-1]


def test_discovered_types_keep_every_value(spark, tmp_path):
    from ratelens.sources import files

    rows = ["a,b,c,d,e,f", "1,1,1.5,2024-01-02,x,", "2,,oops,2024-01-03,7,NA", "9223372036854775808,3,2,,nan,"]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(rows) + "\n")
    got = files.read_csv_discovered(spark, str(path))
    assert [t for _, t in got.dtypes] == ["double", "double", "string", "date", "string", "double"]
    assert [r["c"] for r in got.collect()] == ["1.5", "oops", "2"]
    assert [r["e"] for r in got.collect()] == ["x", "7", None]
    report = files.widened_columns(files.read_csv(spark, str(path), types={}), {"c": T.DoubleType(), "b": T.DoubleType(), "e": T.StringType()})
    assert [tuple(r) for r in report.collect()] == [("c", "double", "text", 1)]
    whole = tmp_path / "w.csv"
    whole.write_text("n\n1\n-2\n")
    assert files.read_csv_discovered(spark, str(whole)).dtypes == [("n", "bigint")]


def test_a_rule_that_is_not_computed_does_not_pass(spark):
    from ratelens.operators import contract

    found = contract._finish(spark.createDataFrame([("a", 0)], "rule string, violations long"), {"a": "x", "b": "y"})
    assert [(r["rule"], r["passed"]) for r in found.collect()] == [("a", True), ("b", False)]


def test_closing_report_evaluates_the_cleaned_rows_once(spark, monkeypatch):
    from ratelens.plans import quality as plans

    rows = [("L1", " A ", "2001-01-02", 5.0, 10.0), ("L1", "A", "2001-01-02", 5.0, 10.0), ("L2", None, "no", -1.0, 20.0)]
    raw = spark.createDataFrame(rows, "load_id string, pickup string, date string, weight double, posted_rate double")
    monkeypatch.setattr(plans, "loads_raw", lambda s, d: raw)
    out = plans.QUERIES["dq15_final_report"].run(spark, "")
    assert "Deduplicate" not in out._jdf.queryExecution().analyzed().toString()  # every section reads what was handed over
    found = {(r["section"], r["item"]): r["value"] for r in out.collect()}
    assert found["shape", "rows"] == 2 and found["duplicates", "duplicate_rows"] == 0 and found["duplicates", "load_id"] == 0
    assert found["missing", "date"] == 1 and found["missing", "weight"] == 1 and found["target", "mean"] == 15.0


@pytest.mark.parametrize("single", [0, 40])
def test_closing_report_shuffles_whole_only_what_may_repeat(spark, monkeypatch, single):
    twice = [("a", 1.0, 0.0), ("a", 1.0, -0.0), ("a", 2.0, 0.0), (None, None, 1.0), (None, None, 1.0), (None, 3.0, None), ("b", 1.0, 5.0)]
    df = spark.createDataFrame(twice + [(f"s{i}", None, float(i)) for i in range(single)], "load_id string, weight double, posted_rate double")
    seen = []
    whole = quality.duplicate_rows
    monkeypatch.setattr(quality, "duplicate_rows", lambda given: seen.append(given) or whole(given))
    found = {(r["section"], r["item"]): r["value"] for r in quality.final_report(df).collect()}
    assert found["duplicates", "duplicate_rows"] == whole(df).first()[0] == 2
    assert found["duplicates", "load_id"] == quality.key_report(df).first()["duplicates"] == 4
    assert found["shape", "rows"] == 7 + single and found["target", "count"] == 6 + single
    assert seen[0].count() == (6 if single else 7)  # where most rows repeat the table is taken as it is
    no_key = {(r["section"], r["item"]): r["value"] for r in quality.final_report(df.drop("load_id")).collect()}
    assert no_key["duplicates", "duplicate_rows"] == whole(df.drop("load_id")).first()[0]
    empty = {(r["section"], r["item"]): r["value"] for r in quality.final_report(df.limit(0)).collect()}
    assert empty["shape", "rows"] == empty["duplicates", "duplicate_rows"] == empty["duplicates", "load_id"] == 0
