"""Hand rows for every branch, edges and nulls."""
from datetime import date, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stockhealth.functions import columns as C
from stockhealth.operators import forecast as FC
from stockhealth.operators import metrics as M
from stockhealth.operators import reports as R
from stockhealth.policy import Policy
from stockhealth.schema import STOCK_DAILY

DAY = date(2026, 1, 1)


def stock(spark, series):
    """{(location, item): [(issued, closing, lead), ...]} on consecutive days."""
    return spark.createDataFrame(
        [(DAY + timedelta(days=i), loc, item, 0, 0, issued, closing, lead)
         for (loc, item), days in series.items() for i, (issued, closing, lead) in enumerate(days)], STOCK_DAILY)


CASES = [
    # issued, closing, lead -> status, rounded status, priority
    (10, 0, 3, "red", "red", "Critical"),
    (10, 15, 3, "red", "red", "High"),        # urgency <= 0
    (10, 15, 1, "red", "red", "High"),        # cover < 2, urgency > 0
    (10, 20, 0, "orange", "red", "Medium"),   # exactly 2
    (10, 20, 1, "orange", "red", "High"),     # cover = lead + 1
    (10, 50, 3, "orange", "orange", "Medium"),  # exactly 5
    (10, 60, 5, "green", "green", "High"),    # green, yet within lead + 1
    (10, 90, 5, "green", "green", "Low"),
    (0, 90, 5, "unknown", "unknown", "Unknown"),
    (None, 90, 5, "unknown", "unknown", "Unknown"),
    (10, None, 5, "unknown", "unknown", "Unknown"),
    (10, 90, None, "green", "green", "Unknown"),
]


def test_every_branch(spark):
    daily = stock(spark, {("L", f"{i:02d}"): [c[:3]] for i, c in enumerate(CASES)})
    exact = [(r.status, r.priority) for r in M.metrics(daily).orderBy("item").collect()]
    rounded = [(r.status, r.priority) for r in M.metrics_rounded(daily).orderBy("item").collect()]
    assert exact == [(c[3], c[5]) for c in CASES]
    assert rounded == [(c[4], c[5]) for c in CASES]


def test_null_closing_stays_null(spark):
    r = M.metrics(stock(spark, {("L", "a"): [(10, None, 5)]})).first()
    assert (r.suggested_reorder, r.potential_waste, r.optimal_stock) == (None, None, 100.0)
    r = M.metrics(stock(spark, {("L", "a"): [(None, 90, 5)]})).first()
    assert (r.avg_daily_issue, r.days_of_cover, r.suggested_reorder, r.potential_waste) == (0.0, None, 0.0, 90.0)
    r = M.metrics_rounded(stock(spark, {("L", "a"): [(None, 90, 5)]})).first()
    assert (r.avg_daily_issue, r.optimal_stock) == (None, 0.0)


def test_rolling_mean_is_rows_and_skips_nulls(spark):
    issued = [7, None, 3, 5, 8, 1, 2, 9, None]
    daily = stock(spark, {("L", "a"): [(x, 1, 1) for x in issued]})
    got = [r.avg_daily_issue for r in M.rolling_issue(daily).orderBy("date").collect()]
    for i, value in enumerate(got):
        seen = [x for x in issued[max(0, i - 6):i + 1] if x is not None]
        assert value == pytest.approx(sum(seen) / len(seen))


def test_half_even_rounding(spark):
    # demand 0.1 * 5 - 0 = 0.5 -> 0; demand 0.3 * 5 = 1.5 -> 2
    daily = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.5)], "item string, estimated_daily_demand double")
    usage = daily.select("*", F.lit(0).cast("long").alias("closing_stock"), F.lit(0).cast("long").alias("lead_time_days"))
    assert [r.suggested_reorder for r in M.score_rounded(usage).orderBy("item").collect()] == [0.0, 2.0, 2.0]


def test_slope_counts_rows_without_issue(spark):
    issued = [4, None, 6, 9]
    daily = stock(spark, {("L", "a"): [(x, 1, 1) for x in issued]})
    n, xs = 4, [1, 2, 3, 4]
    sxy = sum(x * y for x, y in zip(xs, issued) if y is not None)
    sy = sum(y for y in issued if y is not None)
    slope = (n * sxy - sum(xs) * sy) / (n * sum(x * x for x in xs) - sum(xs) ** 2)
    r = FC.trend(daily).first()
    assert (r.history_rows, r.trend_slope) == (4, pytest.approx(slope))
    assert FC.forecast(daily).first().ml_forecasted_demand == pytest.approx(round(sy / 3 + 7 * slope, 2))


def test_forecast_single_row_and_long_history(spark):
    daily = stock(spark, {("L", "one"): [(6, 1, 1)], ("L", "long"): [(100, 1, 1)] * 5 + [(i, 1, 1) for i in range(14)],
                          ("L", "none"): [(0, 1, 1)] * 3})
    got = {r.item: (r.history_rows, r.trend_slope) for r in FC.trend(daily).collect()}
    assert got == {"one": (1, None), "long": (14, 1.0), "none": (3, 0.0)}
    assert {r.item: r.ml_forecasted_demand for r in FC.forecast(daily).collect()} == {"one": 6.0, "long": 13.5, "none": None}


def test_attach_keeps_existing_columns(spark, seed):
    ready = M.metrics(seed).withColumn("estimated_daily_demand", F.lit(1.0))
    got = FC.attach_forecast(ready, FC.forecast(seed))
    assert {r.estimated_daily_demand for r in got.collect()} == {1.0}
    assert FC.attach_forecast(got, FC.forecast(seed)) is got


def test_ranks_and_bands(spark):
    df = spark.createDataFrame([("Critical",), ("High",), ("Medium",), ("Low",), ("Unknown",), ("other",), (None,)], "p string")
    assert [r[0] for r in df.select(C.priority_rank(F.col("p"))).collect()] == [0, 1, 2, 3, 4, 4, 4]
    values = spark.createDataFrame([(2.0,), (2.1,), (5.0,), (5.1,), (None,)], "v double")
    got = [r[0] for r in values.select(C.band(F.col("v"), [2, 5], ["a", "b", "c"])).collect()]
    assert got == ["a", "b", "b", "c", None]
    with pytest.raises(ValueError):
        C.band(F.col("v"), [2, 5], ["a"])


def test_printf_text_matches_python(spark):
    values = [0.25, 0.35, 0.45, 2.675, 1234.55, 0.05, 0.95, 12345678.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(C.printf_text(F.col("v"))).collect()] == [f"{v:.1f}" for v in values]


def test_purchase_orders_collapse_and_first(spark):
    schema = "location string, item string, priority string, days_of_cover double, lead_time_days long, suggested_reorder double"
    df = spark.createDataFrame([
        ("L", "a", "Critical", 0.0, None, 10.0), ("L", "a", "Low", 4.0, 6, 5.0),
        ("L", "b", "Unknown", None, 3, 2.0), ("L", "b", "Medium", 3.0, None, 1.0),
        ("L", "c", "Low", 4.5, 1, 0.0),
    ], schema)
    got = [tuple(r) for r in R.purchase_orders(df).collect()]
    assert got == [("High", "a", "L", 15.0, 0.0, 6), ("Medium", "b", "L", 3.0, 3.0, 3)]


def test_quick_actions_fill_in_priority(spark):
    daily = stock(spark, {("L", f"{i:02d}"): [c[:3]] for i, c in enumerate(CASES)})
    quick = R.quick_actions(M.metrics(daily).drop("priority")).collect()
    # The short form knows no "within lead + 1" case: at exactly two days both are Medium.
    assert [(r.item, r.priority) for r in quick] == [
        ("00", "Critical"), ("01", "High"), ("02", "High"), ("03", "Medium"), ("04", "Medium")]


def test_at_risk_list_thresholds(spark):
    daily = stock(spark, {("L", f"{i:02d}"): [c[:3]] for i, c in enumerate(CASES)})
    snapshot = M.metrics(daily)
    assert R.at_risk_list(snapshot, 0.0).count() == 1 + 3
    assert R.at_risk_list(snapshot).count() == R.at_risk_list(snapshot, 5.0).count() == M.at_risk(snapshot).count()
    assert R.at_risk_list(snapshot.drop("priority", "urgency_score")).columns[:2] == ["priority", "location"]


def test_trends_need_enough_rows(spark):
    daily = stock(spark, {("L", "one"): [(1, 5, 1)], ("L", "two"): [(1, 0, 1), (1, 5, 1)],
                          ("L", "three"): [(1, 0, 1), (1, 5, 1), (1, 9, 1)]})
    assert rows(R.trend_change(daily), "item", "stock_change", "change_pct") == [("three", 4, 80.0), ("two", 5, 0.0)]
    assert rows(R.trend_direction(daily), "item", "direction") == [("three", "Declining")]


def test_policy_is_used(spark):
    daily = stock(spark, {("L", "a"): [(10, 50, 1)]})
    r = M.metrics(daily, Policy(target_days=10, orange_days=4.0)).first()
    assert (r.suggested_reorder, r.status) == (50.0, "green")


def test_slice(spark, daily):
    snapshot = M.metrics(daily)
    wanted = spark.createDataFrame([("Supplier#000000001",)], "name string")
    by_table = R.slice_metrics(snapshot, wanted, ["PROMO", "SMALL"])
    by_list = R.slice_metrics(snapshot, ["Supplier#000000001"], ["PROMO", "SMALL"])
    assert rows(by_table, *snapshot.columns) == rows(by_list) and by_list.count() == 2
    assert R.slice_metrics(snapshot).count() == snapshot.count()
