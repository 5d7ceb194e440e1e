"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The ledger and the action log are derived once and written as Parquet; that time is reported as
``derive_inputs`` and each query then reads the files, as it would read the real tables. A query is
run to its full result (``noop`` sink), once to warm up and then ``BENCH_RUNS`` times; the best run
counts. The total is the sum over all queries, inputs included.
"""
from __future__ import annotations

import json
import os
import sys
import time
from datetime import date

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from stockhealth.operators import actions as A  # noqa: E402
from stockhealth.operators import changes as CH  # noqa: E402
from stockhealth.operators import forecast as FC  # noqa: E402
from stockhealth.operators import metrics as M  # noqa: E402
from stockhealth.operators import reports as R  # noqa: E402
from stockhealth.plans import inputs  # noqa: E402
from stockhealth.session import build_session, shared_path  # noqa: E402
from stockhealth.streaming import queries as S  # noqa: E402


def naive_metrics(daily: DataFrame) -> DataFrame:
    """The snapshot as the view is written: a window over all history, then the last row. For comparison."""
    newest = Window.partitionBy("location", "item").orderBy(F.col("date").desc())
    usage = M.rolling_issue(daily).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    return M.score(usage.drop("rn"))


def best(run, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(min(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    root = shared_path(spark, "bench")

    def derive() -> None:
        inputs.stock_daily(spark, sf_dir).write.mode("overwrite").parquet(f"{root}/daily")
        inputs.action_logs(spark, sf_dir).write.mode("overwrite").parquet(f"{root}/actions")

    seconds = {"derive_inputs": best(derive, 1)}

    daily = spark.read.parquet(f"{root}/daily")
    log = spark.read.parquet(f"{root}/actions")
    M.metrics(daily).write.parquet(f"{root}/metrics")
    snapshot = spark.read.parquet(f"{root}/metrics")
    inputs.change_feed(daily).write.parquet(f"{root}/feed")
    feed = spark.read.parquet(f"{root}/feed")
    old, new = inputs.snapshot_pair(daily)

    batch = {
        "metrics": lambda: M.metrics(daily),
        "metrics_since": lambda: M.metrics(daily, since=date(2001, 1, 1)),
        "metrics_naive": lambda: naive_metrics(daily),
        "metrics_history": lambda: M.metrics_history(daily),
        "metrics_rounded": lambda: M.metrics_rounded(daily),
        "forecast": lambda: FC.forecast(daily),
        "metrics_forecast": lambda: FC.metrics_forecast(daily),
        "trend_change": lambda: R.trend_change(daily),
        "trend_direction": lambda: R.trend_direction(daily),
        "kpis": lambda: R.kpis(snapshot),
        "at_risk_list": lambda: R.at_risk_list(snapshot),
        "purchase_orders": lambda: R.purchase_orders(M.at_risk(snapshot)),
        "action_summary": lambda: A.action_summary(log),
        "pending_actions": lambda: A.pending_actions(log),
        "enrich_actions": lambda: A.enrich_actions(log, snapshot),
        "snapshot_diff": lambda: CH.snapshot_diff(old, new),
        "change_log": lambda: CH.change_log(feed),
    }
    for name, build in batch.items():
        seconds[name] = best(lambda: build().write.format("noop").mode("overwrite").save(), runs)

    def stream() -> None:
        S.refresh(spark, f"{root}/daily", shared_path(spark, "out"), shared_path(spark, "state"), buckets=int(cpus))

    seconds["stream_metrics"] = best(stream, 1)
    rows = daily.count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"), "daily_rows": rows,
        "metrics_rows_per_sec": round(rows / seconds["metrics"]),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
