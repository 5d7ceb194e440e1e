"""Readers, writers, contracts and the action log."""
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stockhealth.operators import actions as A
from stockhealth.operators import changes as CH
from stockhealth.operators import metrics as M
from stockhealth.operators import narrative as N
from stockhealth.operators import reports as R
from stockhealth.schema import ACTION_LOGS, METRIC_COLUMNS, STOCK_DAILY
from stockhealth.sources import contracts, id_blocks, tables


def test_csv_in_any_column_order(spark, seed, fresh):
    path = fresh("csv")
    tables.export_csv(seed.select(*reversed(seed.columns)), path)
    back = tables.read_stock_csv(spark, path)
    assert back.schema == STOCK_DAILY and rows(back) == rows(seed)


def test_upload_checks(spark, fresh):
    path = fresh("upload")
    text = spark.createDataFrame([("2026-01-01", "a", "b", "1", "x"), ("soon", "a", "b", "2", "3"), ("2026-01-01", "a", "b", None, "3")],
                                 "date string, location string, item string, issued string, closing_stock string")
    tables.export_csv(text, path)
    upload = tables.read_upload_csv(spark, path)
    assert contracts.missing_columns(upload) == ["opening_stock", "received", "lead_time_days"]
    assert tuple(contracts.validate_upload(upload).first()) == ("opening_stock, received, lead_time_days", 3, 2)


def test_bad_upload_is_refused(spark, fresh):
    bad = spark.createDataFrame([("2026-01-01", "a", "b", "1", "1", "1", "many", "1")], STOCK_DAILY.fieldNames())
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.append_stock(bad, fresh())


def test_append_keeps_duplicates(spark, seed, fresh):
    path = fresh()
    tables.append_stock(seed, path)
    tables.append_stock(seed.limit(1), path)
    assert tables.read_stock(spark, path).count() == 19


def test_resolve_precedence(spark, seed):
    snapshot = M.metrics(seed)
    upper = snapshot.toDF(*[c.upper() for c in snapshot.columns])
    df, source = tables.resolve_metrics(spark, seed, "no_dt", "no_v")
    assert source == "computed" and df.count() == 3
    assert tables.resolve_metrics(spark, seed, "no_dt", "no_v", with_forecast=False)[0].first().ml_forecasted_demand is None
    upper.createOrReplaceTempView("some_v")
    df, source = tables.resolve_metrics(spark, seed, "no_dt", "some_v")
    assert source == "view" and df.columns[:13] == METRIC_COLUMNS and "estimated_daily_demand" in df.columns
    upper.where("location = 'East'").createOrReplaceTempView("some_dt")
    df, source = tables.resolve_metrics(spark, seed, "some_dt", "some_v")
    assert source == "refreshed_table" and df.count() == 1


def test_coerce(spark):
    df = spark.createDataFrame([("1.5", "x"), ("n/a", "y")], "closing_stock string, item string")
    assert [tuple(r) for r in tables.coerce_numeric(df).collect()] == [(1.5, "x"), (None, "y")]


def test_exports_are_ordered(spark, daily, fresh):
    path = fresh("po")
    orders = R.purchase_orders(M.at_risk(M.metrics(daily)))
    tables.export_po(orders, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["priority", "item", "location", "suggested_reorder", "lead_time_days"]
    assert [r.item + r.location for r in back.collect()] == [r.item + r.location for r in orders.collect()]


def test_contract(spark, seed):
    snapshot = M.metrics(seed).drop("priority").withColumnRenamed("status", "STATUS")
    got = {r.column_name: (r.present, r.rows_with_value) for r in contracts.check_contract(snapshot).collect()}
    assert len(got) == 13 and got["priority"] == (False, 0) and got["status"] == (True, 3)


ACTION = [("TEST_USER", "TEST_ACTION", "Test Location", "Test Item", "Medium", 5.0, 100.0, '{"source":"test_script","test":true}', "PENDING")]
ACTION_COLUMNS = ("user_id string, action_type string, location string, item string, priority string, days_of_cover double, "
                  "suggested_reorder double, action_details string, status string")


def test_action_roundtrip(spark, fresh):
    path = fresh("log")
    first = A.log_actions(spark.createDataFrame(ACTION, ACTION_COLUMNS), as_of=datetime(2026, 1, 1, 8))
    tables.append_actions(first, path)
    log = tables.read_table(spark, path)
    bare = spark.createDataFrame([("VIEW_DETAILS",), ("VIEW_DETAILS",)], "action_type string")
    tables.append_actions(A.log_actions(bare, log, as_of=datetime(2026, 1, 2, 8)), path)
    log = tables.read_table(spark, path).select(*ACTION_LOGS.fieldNames())
    got = {r.action_id: r for r in log.collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].user_id, got[1].status, got[1].days_of_cover) == ("TEST_USER", "PENDING", 5.0)
    assert got[2].status == "PENDING" and got[2].user_id and got[2].action_timestamp == datetime(2026, 1, 2, 8)
    details = A.parse_details(log.where("action_id = 1")).select(A.detail("source").alias("s"), A.detail("test", "boolean").alias("t"))
    assert tuple(details.first()) == ("test_script", True)
    assert A.render_details(A.parse_details(log)).where("action_id = 2").first().action_details == ""
    assert rows(contracts.check_enums(log)) == [("action_type", "TEST_ACTION", 1)]
    assert [r.action_id for r in A.load_actions(log, 2).collect()] == [3, 2]
    assert [r.action_id for r in A.load_actions(log, 5, "TEST_USER").collect()] == [1]
    assert [r.action_id for r in A.recent_actions(log, datetime(2026, 1, 2, 8)).collect()] == [3, 2, 1]
    assert [r.action_id for r in A.recent_actions(log, datetime(2026, 1, 2, 8, 0, 1)).collect()] == [3, 2]
    assert [r.action_id for r in A.pending_actions(log).collect()] == [1, 3, 2]
    assert tuple(A.action_totals(A.action_summary(log)).first()) == (3, 2)


def test_user_fallbacks(spark):
    one = spark.range(1)
    names = one.select(A.user_or_default("ann"), A.user_or_default(None), A.user_or_default(None, connected=False)).first()
    assert names[0] == "ann" and names[1] and names[2] == "local_user"


def test_details(spark, seed, fresh):
    details = seed.limit(1).select(A.stock_entry_details("ann").alias("d")).first().d
    assert details.startswith('{"source":"manual_input","date":"20') and details.endswith('"entered_by":"ann"}')
    upload = A.upload_details(seed, "ann", "a.csv").first()
    assert upload.action_details == '{"source":"csv_upload","rows_uploaded":18,"uploaded_by":"ann","file_name":"a.csv"}'


def test_export_logs(daily):
    at_risk = M.at_risk(M.metrics(daily))
    n = at_risk.count()
    rows_ = A.log_priority_export(at_risk).collect()
    assert len(rows_) == min(10, n) and f'"total_items":{n}' in rows_[0].action_details
    orders = R.purchase_orders(at_risk)
    logged = A.log_actions(A.log_po_export(orders), order=A.po_export_order(), user="u")
    assert [r.item + r.location for r in logged.orderBy("action_id").collect()] == [r.item + r.location for r in orders.collect()]
    assert {r.status for r in logged.collect()} == {"COMPLETED"}


def test_enrich_and_refuse_cover_all(daily, actions):
    snapshot = M.metrics(daily)
    kept, refused = A.enrich_actions(actions, snapshot), A.refused_actions(actions, snapshot)
    assert kept.count() + refused.count() == actions.count() and refused.where("location IS NULL").count() > 0


def test_summary_table(spark, seed, fresh):
    path = fresh("summaries")
    for day in (1, 2):
        tables.append_summary(N.daily_summary(M.at_risk(M.metrics(seed)), date(2026, 1, day), datetime(2026, 1, day, 8)), path)
    assert [str(r.summary_date) for r in spark.read.parquet(path).orderBy("summary_date").collect()] == ["2026-01-01", "2026-01-02"]


def diff_rows(spark, old, new):
    frame = lambda data: spark.createDataFrame([(date(2026, 1, d), "L", i, 0, 0, 0, c, 1) for d, i, c in data], STOCK_DAILY)
    return rows(CH.snapshot_diff(frame(old), frame(new)), "change_type", "item", "old_closing_stock", "new_closing_stock")


def test_snapshot_diff(spark):
    assert diff_rows(spark, [(1, "same", 1), (1, "gone", 2), (1, "changed", 3)], [(1, "same", 1), (1, "new", 4), (1, "changed", 5)]) == [
        ("DELETE", "gone", 2, None), ("INSERT", "new", None, 4), ("UPDATE", "changed", 3, 5)]
    # Null closing stock is a value like any other.
    assert diff_rows(spark, [(1, "a", None)], [(1, "a", 5)]) == [("UPDATE", "a", None, 5)]
    assert diff_rows(spark, [], [(1, "a", None)]) == [("INSERT", "a", None, None)]


def test_snapshot_diff_with_repeated_keys(spark):
    old, new = [(1, "a", 1)] * 3 + [(1, "a", 2)], [(1, "a", 1), (1, "a", 3)]
    assert diff_rows(spark, old, new) == [
        ("DELETE", "a", 1, None), ("DELETE", "a", 1, None), ("DELETE", "a", 2, None), ("INSERT", "a", None, 3)]
    assert diff_rows(spark, old, old[:3]) == [("DELETE", "a", 2, None)]


def test_new_alerts_cooldown(spark, seed):
    at = datetime(2026, 1, 1, 12)
    alerts = spark.createDataFrame([(datetime(2026, 1, 1, 11), "East", "ORS"), (datetime(2026, 1, 1, 11, 0, 1), "Central", "Amoxicillin")],
                                   "alert_timestamp timestamp_ntz, location string, item string")
    assert rows(CH.new_alerts(M.metrics(seed), alerts, at), "location") == [("East",)]


def test_writers_at_the_same_time(spark, fresh):
    path, block = fresh("log"), 3
    new = spark.createDataFrame([("VIEW_DETAILS", i) for i in range(7)], "action_type string, k int")

    def write(n):
        tables.append_as_writer(new, path, [F.col("k").asc()], user=f"w{n}", as_of=datetime(2026, 1, 1, 8), block=block)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    write(4)
    tables.append_as_writer(new.limit(0), path, block=block)
    log = tables.read_actions(spark, path).collect()
    assert len(log) == 35 and len({r.action_id for r in log}) == 35
    blocks = {}
    for r in log:
        blocks.setdefault((r.action_id - 1) // block, set()).add(r.user_id)
    assert len(blocks) == 15 and all(len(users) == 1 for users in blocks.values())
    before = max(r.action_id for r in log if r.user_id != "w4")
    assert min(r.action_id for r in log if r.user_id == "w4") > before


def test_id_of_a_position(spark):
    ids = spark.range(1, 8).select(id_blocks.id_at(F.col("id"), [2, 5, 6], 3)).collect()
    assert [r[0] for r in ids] == [7, 8, 9, 16, 17, 18, 19]
    assert [id_blocks.next_block(n, 3) for n in (None, 1, 3, 4)] == [0, 1, 1, 2]


def test_blocks_are_claimed_once(spark, fresh):
    path = fresh("log")
    with ThreadPoolExecutor(8) as pool:
        got = [b for blocks in pool.map(lambda _: id_blocks.claim_blocks(spark, path, 0, 5), range(8)) for b in blocks]
    assert sorted(got) == list(range(40))


def test_footer_profile_reads_no_column(spark, seed, fresh):
    stock, log = fresh("stock"), fresh("log")
    tables.append_stock(seed, stock)
    tables.append_actions(A.log_actions(spark.createDataFrame(ACTION, ACTION_COLUMNS), as_of=datetime(2026, 1, 1, 8)), log)
    got = contracts.footer_profile(spark, {"stock": stock, "log": log}, "date")
    ends = seed.agg(F.min("date"), F.max("date")).first()
    assert rows(got) == [("log", 1, None, None), ("stock", 18, *ends)]
    plan = got._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "PushedAggregation: [COUNT(*), MIN(date), MAX(date)]" in plan and "PushedAggregation: [COUNT(*)]" in plan
    assert "FileScan" not in plan
    assert rows(contracts.footer_profile(spark, {"log": log}, "action_date")) == [("log", 1, None, None)]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
