"""Stock-health metrics per (location, item)."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockhealth.functions import columns as C
from stockhealth.operators.keyed import lookback, newest_rows
from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import METRIC_COLUMNS, PAIR

# With the date these fix the order of every value the scores read; rows equal in all are interchangeable.
SCORE_TIES = ["closing_stock", "issued", "lead_time_days"]
ROW_TIES = [*SCORE_TIES, "opening_stock", "received"]


def rolling_issue(daily: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Mean issue over the current and the preceding rows (7 in all) of each pair, nulls ignored."""
    back = policy.window_rows - 1

    def add_average(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
        frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-back, 0)
        return df.withColumn("avg_daily_issue", F.avg("issued").over(frame))

    return lookback(daily, PAIR, ["date", *SCORE_TIES], back, "issued", add_average, policy.hot_rows)


def latest_per_pair(daily: DataFrame, since: date | None = None) -> DataFrame:
    """The newest row of each pair."""
    return newest_rows(daily, PAIR, ROW_TIES, 1, since).drop("rn")


def score(usage: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """All derived columns from date, pair, closing_stock, lead_time_days and avg_daily_issue."""
    days, lead, closing = F.col("days_of_cover"), F.col("lead_time_days"), F.col("closing_stock")
    average = F.col("avg_daily_issue")
    scored = usage.withColumn("days_of_cover", C.days_of_cover(closing, average)).withColumn(
        "avg_daily_issue", F.coalesce(average, F.lit(0.0))
    )
    return scored.withColumns({
        "status": C.status_band(days, policy),
        "suggested_reorder": C.suggested_reorder(closing, average, policy),
        "urgency_score": C.urgency_score(days, lead),
        "priority": C.priority(days, lead, policy),
        "potential_waste": C.potential_waste(closing, average, policy),
        "optimal_stock": C.optimal_stock(lead, average, policy),
    })


def recent_usage(daily: DataFrame, policy: Policy = DEFAULT_POLICY, since: date | None = None) -> DataFrame:
    """Latest row per pair with its rolling mean.

    Only the newest 7 rows of a pair can enter the mean of its last row, so history is cut before
    the exchange and the rest is one grouped aggregate on the same partitioning.
    """
    newest = newest_rows(daily.select(*PAIR, "date", *SCORE_TIES), PAIR, SCORE_TIES, policy.window_rows, since)
    last = F.min_by(F.struct("date", "closing_stock", "lead_time_days"), "rn")
    return (
        newest.groupBy(*PAIR)
        .agg(last.alias("last"), F.avg("issued").alias("avg_daily_issue"))
        .select("last.date", *PAIR, "last.closing_stock", "last.lead_time_days", "avg_daily_issue")
    )


def metrics(daily: DataFrame, policy: Policy = DEFAULT_POLICY, since: date | None = None) -> DataFrame:
    """The metrics snapshot: 13 columns, one row per pair. ``since``: see ``newest_rows``."""
    return score(recent_usage(daily, policy, since), policy).select(*METRIC_COLUMNS)


def metrics_history(daily: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Every day scored."""
    usage = rolling_issue(daily.select(*PAIR, "date", *SCORE_TIES), policy)
    return score(usage, policy).select(
        *PAIR, "closing_stock", "avg_daily_issue", "days_of_cover", "lead_time_days", "status", "suggested_reorder"
    )


def at_risk(snapshot: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return snapshot.where(C.is_at_risk(F.col("days_of_cover"), policy.orange_days))


def score_rounded(usage: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The rounded dialect on ``estimated_daily_demand``.

    Bands are right-closed and results round half to even. Demand has two decimals, so the products
    are formed in DECIMAL and a tie is a tie.
    """
    days, lead, closing = F.col("days_of_cover"), F.col("lead_time_days"), F.col("closing_stock")
    demand = F.coalesce(F.col("estimated_daily_demand"), F.lit(0.0)).cast("decimal(18,2)")

    def whole(value: Column) -> Column:
        return F.bround(value.cast("double"), 0)

    return usage.withColumn(
        "days_of_cover", C.days_of_cover(closing, F.col("estimated_daily_demand"))
    ).withColumns({
        "status": C.band(days, [policy.red_days, policy.orange_days], ["red", "orange", "green"], "unknown"),
        "suggested_reorder": whole(C.clamp_zero(policy.target_days * demand - closing)),
        "urgency_score": C.urgency_score(days, lead),
        "priority": C.priority(days, lead, policy),
        "potential_waste": whole(C.clamp_zero(closing - policy.overstock_days * demand)),
        "optimal_stock": whole((policy.target_days + lead) * demand),
    })


ROUNDED_COLUMNS = [
    "date", "location", "item", "opening_stock", "received", "issued", "closing_stock", "lead_time_days",
    "avg_daily_issue", "ml_forecasted_demand", "estimated_daily_demand", "days_of_cover", "status",
    "suggested_reorder", "urgency_score", "priority", "potential_waste", "optimal_stock",
]


def metrics_rounded(daily: DataFrame, policy: Policy = DEFAULT_POLICY, since: date | None = None) -> DataFrame:
    """Snapshot in the rounded dialect with the rolling average as demand."""
    newest = newest_rows(daily.select(*PAIR, "date", *ROW_TIES), PAIR, ROW_TIES, policy.window_rows, since)
    usage = newest.groupBy(*PAIR).agg(
        F.min_by(F.struct("date", *ROW_TIES), "rn").alias("last"),
        F.bround(F.avg("issued"), 2).alias("avg_daily_issue"),
    ).select(
        *PAIR, "last.*", "avg_daily_issue",
        F.lit(None).cast("double").alias("ml_forecasted_demand"),
        F.col("avg_daily_issue").alias("estimated_daily_demand"),
    )
    return score_rounded(usage, policy).select(*ROUNDED_COLUMNS)
