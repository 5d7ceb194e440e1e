"""Expected values on the 18-row seed."""
import pytest
from helpers import rows

from stockhealth.operators import forecast as FC
from stockhealth.operators import metrics as M
from stockhealth.operators import narrative as N
from stockhealth.operators import reports as R
from stockhealth.sources import contracts, tables


def by_location(df):
    return {r["location"]: r for r in df.collect()}


def test_seed_replaces(spark, seed_csv, fresh):
    path = fresh()
    for _ in range(2):
        tables.seed(spark, seed_csv, path)
    profile = contracts.profile(tables.read_stock(spark, path)).first()
    assert (profile.row_count, profile.locations, profile.items) == (18, 3, 3)
    assert (str(profile.min_date), str(profile.max_date)) == ("2025-12-27", "2026-01-01")


def test_metrics(seed):
    got = by_location(M.metrics(seed))
    expected = {
        "Central": (30, 31.666667, 0.947368, 5, "red", 128.333333, -4.052632, "High", 0, 317),
        "East": (5, 49.166667, 0.101695, 4, "red", 240.833333, -3.898305, "High", 0, 443),
        "West": (40, 18.333333, 2.181818, 7, "orange", 51.666667, -4.818182, "High", 0, 220),
    }
    names = ["closing_stock", "avg_daily_issue", "days_of_cover", "lead_time_days", "status", "suggested_reorder",
             "urgency_score", "priority", "potential_waste", "optimal_stock"]
    for location, values in expected.items():
        for name, value in zip(names, values):
            assert got[location][name] == (value if isinstance(value, str) else pytest.approx(value, abs=1e-6)), name


def test_rounded_dialect(seed):
    got = by_location(M.metrics_rounded(seed))
    assert {k: (r.avg_daily_issue, r.suggested_reorder, r.optimal_stock, r.status) for k, r in got.items()} == {
        "Central": (31.67, 128.0, 317.0, "red"), "East": (49.17, 241.0, 443.0, "red"), "West": (18.33, 52.0, 220.0, "orange")}


def test_forecast(seed):
    slopes = {r.location: r.trend_slope for r in FC.trend(seed).collect()}
    assert slopes == pytest.approx({"Central": -2.457143, "East": -9.857143, "West": -1.885714}, abs=1e-6)
    assert {r.location: r.ml_forecasted_demand for r in FC.forecast(seed).collect()} == {
        "Central": 14.47, "East": None, "West": 5.13}
    compared = FC.forecast_compare(FC.attach_forecast(M.metrics(seed), FC.forecast(seed)))
    assert rows(compared, "location", "forecast_change") == [("Central", -54.3), ("West", -72.0)]


def test_metrics_on_estimated_demand(seed):
    got = by_location(FC.metrics_forecast(seed))
    assert {k: (r.estimated_daily_demand, round(r.days_of_cover, 4), r.status, r.priority, r.suggested_reorder,
                r.optimal_stock) for k, r in got.items()} == {
        "Central": (14.47, 2.0733, "orange", "High", 42.0, 145.0),
        "East": (49.17, 0.1017, "red", "High", 241.0, 443.0),
        "West": (5.13, 7.7973, "green", "High", 0.0, 62.0)}


def test_reports(seed):
    snapshot = M.metrics(seed)
    assert tuple(R.kpis(snapshot).first()) == (3, 3, 2, 0, 0.0)
    assert rows(R.location_health(snapshot)) == [("Central", 1, 1), ("East", 1, 1), ("West", 1, 0)]
    changes = {r.location: (r.stock_change, round(r.change_pct, 4)) for r in R.trend_change(seed).collect()}
    assert changes == {"Central": (-25, -45.4545), "East": (-10, -66.6667), "West": (15, 60.0)}
    trends = {r.location: (round(r.recent_avg, 3), round(r.earlier_avg, 3), r.direction) for r in R.trend_direction(seed).collect()}
    assert trends == {"Central": (40.667, 90.0, "Declining"), "East": (8.333, 106.667, "Declining"),
                      "West": (34.0, 76.667, "Declining")}
    inventory = R.inventory_status(seed, snapshot).first()
    assert (inventory.total_opening_stock, inventory.total_received, inventory.total_closing_stock) == (1394, 270, 1069)
    usage = R.usage_status(seed, snapshot).first()
    assert (usage.total_issued, usage.days_of_data) == (595, 6)
    assert R.po_status(snapshot).first().avg_lead_time == pytest.approx(5.3333, abs=1e-4)


def test_texts(seed):
    snapshot = M.metrics(seed)
    prompt = N.summary_prompt(snapshot).first().prompt
    assert prompt.split("\n")[2:6] == [
        "Critical items (red status):", "- ORS at East: Only 0.1 days left, reorder 240.8 units",
        "- Amoxicillin at Central: Only 0.9 days left, reorder 128.3 units", ""]
    assert "- PPE Kits at West: 2.2 days left, reorder 51.7 units" in prompt
    lines = [r.line for r in N.summary_prompt_lines(snapshot).orderBy("section", "pos").collect()]
    assert [x for x in prompt.split("\n") if x] == lines
    summary = N.fallback_summary(M.at_risk(snapshot)).first().summary_text
    assert summary.startswith("🚨 **2 critical item(s)** require immediate attention\n- **ORS** at East: Only 0.1 days")
    assert summary.endswith("Recommended reorder: **51 units**")
    asked = snapshot.select("location", "item").unionByName(snapshot.sparkSession.createDataFrame([("Mars", "ORS")], "location string, item string"))
    texts = {r.location: r.explanation for r in N.explain_reorder(snapshot, asked).collect()}
    assert texts["Mars"].endswith("Location: Mars\nItem not found in inventory metrics.")
    assert "Average daily consumption: 18.33 units/day\nLead time: 7 days" in texts["West"]


def test_empty_texts(seed):
    empty = M.at_risk(M.metrics(seed)).where("false")
    assert N.fallback_summary(empty).first().summary_text == N.ALL_WELL_EMPTY
    assert "Critical items (red status):\nNone\n\nWarning items (orange status):\nNone" in N.summary_prompt(empty).first().prompt
    assert N.summary_prompt_lines(empty).where("line = 'None'").count() == 2
    assert tuple(R.kpis(empty).first()) == (0, 0, 0, 0, 0.0)
