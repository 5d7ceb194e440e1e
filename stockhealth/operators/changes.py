"""Change capture and alerts in batch form."""
from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockhealth.operators.actions import clock
from stockhealth.operators.keyed import lookback
from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import PAIR, STOCK_DAILY, STOCK_KEY
from stockhealth.session import pin

_PAYLOAD = ["opening_stock", "received", "issued", "closing_stock", "lead_time_days"]


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT, UPDATE and DELETE between two versions of the daily table.

    Equal rows cancel out in one hash aggregate with map-side combine, so only changed rows reach the
    step that pairs them by key; unlike a full outer join no side can be skewed. Where a key occurs
    several times in a version, its removed rows are DELETEs and its added rows INSERTs.
    """
    signed = old.select(*STOCK_KEY, *_PAYLOAD, F.lit(-1).alias("_sign")).unionByName(
        new.select(*STOCK_KEY, *_PAYLOAD, F.lit(1).alias("_sign"))
    )
    net = signed.groupBy(*STOCK_KEY, *_PAYLOAD).agg(F.sum("_sign").alias("_net")).where("_net != 0")
    changed = pin(net, "changed")  # usually few rows; both steps below read them
    closing = F.struct("closing_stock")  # a struct is null only when there is no row, whatever its value
    removed, added = F.col("_net") < 0, F.col("_net") > 0
    by_key = changed.groupBy(*STOCK_KEY).agg(
        F.sum(F.when(removed, -F.col("_net")).otherwise(0)).alias("_removed"),
        F.sum(F.when(added, F.col("_net")).otherwise(0)).alias("_added"),
        F.max(F.when(removed, closing)).alias("_old"), F.max(F.when(added, closing)).alias("_new"),
    )
    paired = (F.col("_removed") <= 1) & (F.col("_added") <= 1)
    kind = F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").otherwise("UPDATE")
    simple = by_key.where(paired).select(
        kind.alias("change_type"), *STOCK_KEY,
        F.col("_old.closing_stock").alias("old_closing_stock"), F.col("_new.closing_stock").alias("new_closing_stock"),
    )
    repeated = by_key.where(~paired).select(*[F.col(c).alias(f"_{c}") for c in STOCK_KEY])
    same_key = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in STOCK_KEY])
    copies = F.explode(F.sequence(F.lit(1), F.abs(F.col("_net")).cast("int")))
    single = changed.join(repeated, same_key, "left_semi").withColumn("_copy", copies).select(
        F.when(removed, "DELETE").otherwise("INSERT").alias("change_type"), *STOCK_KEY,
        F.when(removed, F.col("closing_stock")).alias("old_closing_stock"),
        F.when(added, F.col("closing_stock")).alias("new_closing_stock"),
    )
    return simple.unionByName(single)


_VERSION = T.StructType([f for f in STOCK_DAILY if f.name != "date"])  # the day is the folder
DAYS = 10_000  # changed days that are listed in the scan's filter at most


def save_version(daily: DataFrame, path: str) -> None:
    """Store a version of the daily table by day, and for each day an order-free digest: row count and two sums of row hashes."""
    daily.select(*STOCK_KEY, *_PAYLOAD).hint("rebalance", "date").write.partitionBy("date").parquet(f"{path}/rows")
    rows = _version_rows(daily.sparkSession, path)
    # Nulls are told apart by a bit mask, since a hash skips them.
    values = [*PAIR, *_PAYLOAD, *[F.col(c).isNull() for c in (*PAIR, *_PAYLOAD)]]
    hashes = [F.sum(F.xxhash64(F.lit(i), *values).cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)]
    rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *hashes).write.parquet(f"{path}/days")


def _version_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*_VERSION, STOCK_DAILY["date"]])).parquet(f"{path}/rows")


def changed_days(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Days whose digests differ between two stored versions, or that only one of them has; a null day is a day."""
    days = spark.read.parquet(f"{old}/days").unionByName(spark.read.parquet(f"{new}/days"))
    same = (F.count(F.lit(1)) == 2) & (F.min("n") == F.max("n")) & (F.min("h0") == F.max("h0")) & (F.min("h1") == F.max("h1"))
    return days.groupBy("date").agg(same.alias("same")).where("NOT same").select("date")


def diff_versions(spark: SparkSession, old: str, new: str) -> DataFrame:
    """``snapshot_diff`` of two stored versions that reads the rows of changed days only."""
    days = pin(changed_days(spark, old, new), "days")
    parts = [_version_rows(spark, path) for path in (old, new)]
    if days.count() <= DAYS:
        listed = [r["date"] for r in days.collect()]
        known = F.col("date").isin([d for d in listed if d is not None])
        wanted = known | F.col("date").isNull() if None in listed else known
        return snapshot_diff(*[p.where(wanted) for p in parts])
    chosen = days.withColumnRenamed("date", "_date")
    return snapshot_diff(*[p.join(chosen, F.col("date").eqNullSafe(F.col("_date")), "left_semi") for p in parts])


def changes_from_diff(diff: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """``snapshot_diff`` in the form of the change stream, all at one time; a deletion has the stock of the removed row."""
    return diff.select(
        clock(as_of).alias("change_timestamp"), *PAIR, "date", "change_type",
        F.when(F.col("change_type") == "DELETE", F.col("old_closing_stock")).otherwise(F.col("new_closing_stock"))
        .alias("closing_stock"),
    )


def change_log(changes: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Inserts and updates with the closing stock of the row's previous version."""
    kept = changes.where(F.col("change_type").isin("INSERT", "UPDATE")).select(
        "change_timestamp", *PAIR, "date", "change_type", "closing_stock"
    )

    def add_previous(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
        return df.withColumn("_old", F.lag("closing_stock").over(Window.partitionBy(*partition).orderBy(*order)))

    order = ["change_timestamp", "change_type", "closing_stock"]
    logged = lookback(kept, [*PAIR, "date"], order, 1, "closing_stock", add_previous, policy.hot_rows,
                      coarse_keys=PAIR)
    return logged.select(
        "change_timestamp", *PAIR, "date", "change_type",
        F.col("_old").alias("old_closing_stock"), F.col("closing_stock").alias("new_closing_stock"),
    )


def new_alerts(
    snapshot: DataFrame, alerts: DataFrame, as_of: datetime | Column | None = None, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """Pairs with two days or less that had no alert in the last hour. A pair with a null half is a pair like any other."""
    since = clock(as_of) - F.make_dt_interval(hours=F.lit(policy.cooldown_hours))
    if "alert_date" in alerts.columns:  # the folder column of a stored table
        alerts = alerts.where(F.col("alert_date") >= F.to_date(since))
    # One row per pair: a pair that alerts often must not weigh on the join.
    recent = alerts.where(F.col("alert_timestamp") > since).select(*[F.col(c).alias(f"_{c}") for c in PAIR]).distinct()
    same_pair = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PAIR])
    critical = snapshot.where(F.col("days_of_cover") <= policy.alert_days)
    return critical.join(recent, same_pair, "left_anti").select(
        clock(as_of).alias("alert_timestamp"), *PAIR, "days_of_cover", "closing_stock", "suggested_reorder"
    )


def cooled_down(observed: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Observations that alert: in time order, those without an alert of their pair less than the cool-down before.

    A greedy rule needs the order: pairs are dealt to tasks, sorted, and read once with the last alert in hand, so memory
    is one batch however many rows a pair has. Observations
    without a time come last and start no cool-down: one of them alerts only for a pair that has no observation with a time.
    """
    wait = timedelta(hours=policy.cooldown_hours)
    columns = ["action_id", "alert_timestamp", *PAIR, "days_of_cover", "suggested_reorder"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, last = None, None
        for frame in batches:
            picked = []
            halves = [frame[c].where(frame[c].notna(), None) for c in PAIR]
            for row, (key, at) in enumerate(zip(zip(*halves), frame["alert_timestamp"])):
                if key != pair or pd.notna(at) and at >= last + wait:
                    pair, last = key, at
                    picked.append(row)
            yield frame.iloc[picked]

    rows = observed.select(*columns).repartition(*PAIR)
    rows = rows.sortWithinPartitions(*PAIR, F.asc_nulls_last("alert_timestamp"), "action_id")
    return rows.mapInPandas(run, rows.schema)
