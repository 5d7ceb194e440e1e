"""Streams end where the batch ends, whatever the micro-batches."""
import os
import random
from datetime import datetime, timedelta

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stockhealth.operators import changes as CH
from stockhealth.operators import metrics as M
from stockhealth.plans import inputs
from stockhealth.schema import ALERT_OBSERVATIONS, STOCK_CHANGES
from stockhealth.streaming import queries as S
from stockhealth.streaming.history import RefreshLog, read_history, refresh_status


def six(df):
    return rows(df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"}))


@pytest.mark.parametrize("buckets", [1, 16])
def test_metrics_in_steps_out_of_order(spark, daily, fresh, buckets):
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    part = F.pmod(F.hash("date"), F.lit(3))
    history = []
    for step in (2, 0, 1):  # days arrive in no order
        daily.where(part == step).coalesce(2).write.mode("append").parquet(source)
        history += S.refresh(spark, source, target, state, buckets=buckets)
    assert six(S.current_metrics(spark, target)) == six(M.metrics(daily))
    assert six(S.current_at_risk(spark, target)) == six(M.at_risk(M.metrics(daily)))
    done = S.refresh_history(spark, history)
    assert done.agg(F.sum("input_rows")).first()[0] == daily.count()
    assert done.where("input_rows > 0").count() == 3
    assert sum(p["numInputRows"] for p in S.refresh(spark, source, target, state, buckets=buckets)) == 0  # nothing new: nothing done
    compacted = fresh("compact")
    S.compact(spark, target, compacted)
    assert six(S.current_at_risk(spark, compacted)) == six(M.at_risk(M.metrics(daily)))


def test_metrics_with_nulls_and_repeats(spark, seed, fresh):
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    last = F.col("date") == F.lit("2026-01-01").cast("date")
    odd = seed.withColumns({
        "issued": F.when(last & (F.col("location") == "East"), None).otherwise(F.col("issued")),
        "lead_time_days": F.when(F.col("location") == "West", None).otherwise(F.col("lead_time_days")),
        "item": F.when(F.col("location") == "West", None).otherwise(F.col("item")),
    })
    odd = odd.unionByName(odd.where(last)).withColumn("issued", F.when(F.col("location") == "Central", None).otherwise(F.col("issued")))
    odd.repartition(3).write.parquet(source)
    S.stream_metrics(spark, source, target, state, max_files=1, buckets=2).awaitTermination()
    assert six(S.current_metrics(spark, target)) == six(M.metrics(odd))


@pytest.mark.parametrize("max_files, run_rows", [(1, 3), (2, S.RUN), (None, 5)])
def test_change_log_is_independent_of_the_batches(spark, daily, fresh, max_files, run_rows):
    feed = inputs.change_feed(daily.where("location < 'Supplier#000000003'"))
    feed = feed.withColumn("location", F.when(F.col("item") < "M", F.col("location")))  # a null half of the key
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    feed.repartition(5).write.parquet(source)  # rows of any time in every file
    S.stream_change_log(spark, source, target, state, max_files=max_files, run_rows=run_rows).awaitTermination()
    assert rows(S.current_change_log(spark, target)) == rows(CH.change_log(feed))


def greedy(observed):
    last, kept = {}, []
    for r in sorted(observed, key=lambda r: (r.alert_timestamp, r.action_id)):
        key = (r.location, r.item)
        if key not in last or r.alert_timestamp >= last[key] + timedelta(hours=1):
            last[key] = r.alert_timestamp
            kept.append(r.action_id)
    return sorted(kept)


@pytest.mark.parametrize("max_files, run_rows", [(1, 2), (2, S.RUN), (None, 1)])
def test_alert_cooldown_is_independent_of_the_batches(spark, fresh, max_files, run_rows):
    start = datetime(2026, 1, 1)
    minutes = [0, 0, 30, 59, 60, 61, 119, 120, 121, 300, 359, 360]
    data = [(i * 10 + j, start + timedelta(minutes=m), loc, "x", 1.0, 2.0)
            for i, m in enumerate(minutes) for j, loc in enumerate(["a", None][: 1 + i % 2])]
    observed = spark.createDataFrame(data, ALERT_OBSERVATIONS)
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    observed.repartition(5, F.hash("action_id")).write.parquet(source)
    S.stream_alerts(spark, source, target, state, max_files=max_files, run_rows=run_rows).awaitTermination()
    assert sorted(r.action_id for r in S.current_alerts(spark, target).collect()) == greedy(observed.collect())


def test_alerts_of_a_pair_outlast_an_observation_without_a_time(spark, fresh):
    start = datetime(2026, 1, 1)
    at = [None, start, start + timedelta(minutes=30), start + timedelta(hours=5), None]
    data = [(i, t, "a", "x", 1.0, 2.0) for i, t in enumerate(at)] + [(10, None, "b", "x", 1.0, 2.0), (11, None, "b", "x", 1.0, 2.0)]
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    spark.createDataFrame(data, ALERT_OBSERVATIONS).repartition(3, F.hash("action_id")).write.parquet(source)
    S.stream_alerts(spark, source, target, state, max_files=1).awaitTermination()
    assert sorted(r.action_id for r in S.current_alerts(spark, target).collect()) == [1, 3, 10]


def test_alert_upkeep_repeats_after_exactly_an_hour(spark, seed, fresh):
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    start = datetime(2026, 1, 1, 23, 30)  # the hour goes over midnight
    rows_of = seed.withColumn("location", F.when(F.col("location") != "West", F.col("location")))
    critical = M.metrics(rows_of).where("days_of_cover <= 2").count()
    counts = []
    for minutes in (0, 30, 59, 60, 61, 120):
        rows_of.where("false" if minutes else "true").coalesce(1).write.mode("append").parquet(source)
        S.refresh(spark, source, target, state, alert_clock=lambda m=minutes: start + timedelta(minutes=m), buckets=2)
        counts.append(S.critical_alerts(spark, target).count())
    assert critical and counts == [critical, critical, critical, 2 * critical, 2 * critical, 3 * critical]


def test_diff_as_changes(spark, seed):
    later = seed.where("location <> 'East'").withColumn("closing_stock", F.col("closing_stock") + 1)
    got = CH.changes_from_diff(CH.snapshot_diff(seed, later), datetime(2026, 1, 3))
    assert got.columns == STOCK_CHANGES.names
    want = seed.select("location", "item", "date", F.when(F.col("location") == "East", "DELETE").otherwise("UPDATE"),
                       F.col("closing_stock") + F.when(F.col("location") == "East", 0).otherwise(1))
    assert rows(got.drop("change_timestamp")) == rows(want)


def test_empty_source_runs_no_batch(spark, fresh):
    source, target = fresh("in"), fresh("out")
    spark.createDataFrame([], ALERT_OBSERVATIONS).write.parquet(source)
    S.stream_alerts(spark, source, target, fresh("state")).awaitTermination()
    assert S.current_alerts(spark, target).count() == 0


def test_freshness(spark, seed):
    got = S.freshness({"stock": seed, "east": seed.where("location = 'East' AND date < '2026-01-01'")}, datetime(2026, 1, 3))
    assert rows(got, "table_name", "row_count", "days_behind") == [("east", 5, 3), ("stock", 18, 2)]


def folders(path):
    return sorted(p for p in os.listdir(path) if not p.startswith(("_", ".")))


def test_change_log_reads_no_earlier_rows(spark, fresh):
    start = datetime(2026, 1, 1)
    change = lambda minute, stock, item="x": (start + timedelta(minutes=minute), "a", item, start.date(), "UPDATE", stock)
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    arrivals = [[change(m, m) for m in range(0, 400, 10)], [change(5, 5), change(400, 400)], [change(0, 1, "y")], [change(5, 5), change(7, None)]]
    read, told = [], []
    for epoch, part in enumerate(arrivals):
        spark.createDataFrame(part, STOCK_CHANGES).coalesce(1).write.mode("append").parquet(source)
        query = S.stream_change_log(spark, source, target, state, run_rows=4)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        told.append(spark.read.parquet(f"{target}/log/epoch={epoch}").count())
    assert folders(target) == ["log"]  # the rows themselves are kept nowhere but in state
    assert read == [40, 2, 1, 2]
    assert told == [40, 3, 1, 3]  # each new row, and the row after a late one
    whole = spark.createDataFrame([r for part in arrivals for r in part], STOCK_CHANGES)
    assert rows(S.current_change_log(spark, target)) == rows(CH.change_log(whole))


def test_change_log_with_nulls_and_ttl(spark, fresh):
    start = datetime(2026, 1, 1)
    data = [(None, "a", None, None, "INSERT", 1), (start, "a", None, None, "UPDATE", None), (start, "a", None, None, "UPDATE", 3), (start, "a", None, start.date(), "DELETE", 4)]
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    feed = spark.createDataFrame(data * 2, STOCK_CHANGES)
    feed.coalesce(1).write.parquet(source)
    S.stream_change_log(spark, source, target, state).awaitTermination()
    assert rows(S.current_change_log(spark, target)) == rows(CH.change_log(feed))
    # With a time to live, rows in order of time are still right.
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    steps = [[(start + timedelta(hours=h), "a", "x", start.date(), "UPDATE", h) for h in range(at, at + 10)] for at in (0, 10, 20)]
    for part in steps:
        spark.createDataFrame(part, STOCK_CHANGES).coalesce(1).write.mode("append").parquet(source)
        S.stream_change_log(spark, source, target, state, ttl=timedelta(hours=3), run_rows=2).awaitTermination()
    whole = spark.createDataFrame([r for part in steps for r in part], STOCK_CHANGES)
    assert rows(S.current_change_log(spark, target)) == rows(CH.change_log(whole))


def test_late_observations_move_the_alerts_after_them(spark, fresh):
    rng, start = random.Random(2), datetime(2026, 1, 1)
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    seen = []
    for epoch in range(3):
        part = [(100 * epoch + i, None if rng.random() < 0.1 else start + timedelta(minutes=rng.randint(0, 3000)), rng.choice(["a", None]), "x", 1.0, None) for i in range(60)]
        seen += part
        spark.createDataFrame(part, ALERT_OBSERVATIONS).coalesce(1).write.mode("append").parquet(source)
        S.stream_alerts(spark, source, target, state, run_rows=3).awaitTermination()
        whole = spark.createDataFrame(seen, ALERT_OBSERVATIONS)
        assert rows(S.current_alerts(spark, target)) == rows(CH.cooled_down(whole))


def test_alerts_with_a_watermark_keep_little_state(spark, fresh):
    start = datetime(2026, 1, 1)
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    seen = []
    for epoch in range(3):
        part = [(100 * epoch + i, start + timedelta(hours=10 * epoch, minutes=7 * ((i * 37) % 80)), "a", "x", 1.0, 2.0) for i in range(80)] + [(None, None, "a", "x", 1.0, 2.0)]
        seen += part[:-1]
        spark.createDataFrame(part, ALERT_OBSERVATIONS).coalesce(1).write.mode("append").parquet(source)
        S.stream_alerts(spark, source, target, state, watermark="2 hours").awaitTermination()
    newest = max(r[1] for r in seen)
    want = [r for r in rows(CH.cooled_down(spark.createDataFrame(seen, ALERT_OBSERVATIONS))) if r[1] <= newest - timedelta(hours=2)]
    assert want and rows(S.current_alerts(spark, target)) == want
    spark.createDataFrame([(1, start, "a", "x", 1.0, 2.0)], ALERT_OBSERVATIONS).coalesce(1).write.mode("append").parquet(source)
    S.stream_alerts(spark, source, target, state, watermark="2 hours").awaitTermination()
    assert rows(S.current_alerts(spark, target)) == want  # later than the watermark


def test_an_epoch_touches_its_buckets_only(spark, seed, fresh):
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    seed.coalesce(1).write.parquet(source)
    S.refresh(spark, source, target, state, buckets=8)
    first = S.newest_version(spark, target)
    assert len(first.buckets) > 1 and set(first.buckets.values()) == {0}
    one = seed.where("location = 'East'").withColumn("date", F.date_add("date", 30))
    one.coalesce(1).write.mode("append").parquet(source)
    S.refresh(spark, source, target, state, buckets=8)
    second = S.newest_version(spark, target)
    touched = [b for b, v in second.buckets.items() if v == 1]
    assert len(touched) == 1 and {k: v for k, v in second.buckets.items() if k not in touched} == {k: v for k, v in first.buckets.items() if k not in touched}
    assert folders(f"{target}/{S.USAGE}/version=1") == [f"bucket={touched[0]}"]
    # What an epoch reads of the kept rows: partition filters name the version and the bucket.
    kept = S._table(spark, target, S.USAGE, S.USAGE_ROWS, {touched[0]: 0})
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1]
    assert kept.select("bucket").distinct().count() == 1
    assert six(S.current_metrics(spark, target)) == six(M.metrics(seed.unionByName(one)))


def test_full_refresh_and_vacuum(spark, seed, fresh):
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    with pytest.raises(Exception):
        S.rebuild(spark, source, target, state, buckets=2)
    seed.where("location <> 'East'").coalesce(1).write.parquet(source)
    S.refresh(spark, source, target, state, buckets=2)
    before = S.current_metrics(spark, target)
    old = six(before)
    seed.where("location = 'East'").coalesce(1).write.mode("append").parquet(source)
    done = S.rebuild(spark, source, target, state, buckets=2)
    assert six(before) == old  # a reader keeps its version
    assert six(S.current_metrics(spark, target)) == six(M.metrics(seed)) and set(done.buckets.values()) == {done.number}
    assert S.vacuum(spark, target) and folders(f"{target}/{S.METRICS}") == folders(f"{target}/{S.DONE}") == [f"version={done.number}"]
    late = seed.withColumn("date", F.date_add("date", 9))
    late.coalesce(1).write.mode("append").parquet(source)
    S.refresh(spark, source, target, state, buckets=2)
    assert six(S.current_at_risk(spark, target)) == six(M.at_risk(M.metrics(seed.unionByName(late))))


def test_history_outlives_the_query(spark, seed, fresh):
    source, target, state, path = fresh("in"), fresh("out"), fresh("state"), fresh("history")
    assert read_history(spark, path).count() == 0
    seed.coalesce(1).write.parquet(source)
    S.refresh(spark, source, target, state, buckets=1, log=RefreshLog(spark, path), name="stock")

    def broken():
        raise ValueError("no clock")

    seed.coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception):
        S.refresh(spark, source, target, state, buckets=1, alert_clock=broken, log=RefreshLog(spark, path), name="stock")
    history = read_history(spark, path)
    assert rows(history.where("state = 'SUCCEEDED' AND input_rows > 0"), "query_name", "batch_id", "input_rows") == [("stock", 0, 18)]
    at = history.where("state = 'FINISHED'").first().started_at
    status = refresh_status(history, at + timedelta(seconds=61)).first()
    assert (status.state, status.failures, status.lag_seconds, status.within_target) == ("FAILED", 1, 61.0, False) and "no clock" in status.error
    assert refresh_status(history, at + timedelta(seconds=60)).first().within_target


def test_change_log_calls_python_once_for_many_pairs(spark, fresh):
    start = datetime(2026, 1, 1)
    arrivals = [[(start + timedelta(minutes=m + i), None if i % 50 == 0 else f"l{i}", f"i{i % 3}" if i % 7 else None, start.date(), "UPDATE", m + i)
                 for i in range(3000)] for m in (5, 0)]
    source, target, state = fresh("in"), fresh("out"), fresh("state")
    for part in arrivals:
        spark.createDataFrame(part, STOCK_CHANGES).coalesce(1).write.mode("append").parquet(source)
        query = S.stream_change_log(spark, source, target, state, run_rows=50, buckets=8)
        query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    state_rows = sum(s["numRowsTotal"] for p in done for s in p["stateOperators"])
    assert state_rows < 3000  # by bucket, not by pair
    log = spark.read.parquet(f"{target}/log")
    assert log.select("id").distinct().count() == 6000
    whole = spark.createDataFrame([r for part in arrivals for r in part], STOCK_CHANGES)
    assert rows(S.current_change_log(spark, target)) == rows(CH.change_log(whole))
