"""Trend-based demand forecast for all pairs in one job."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockhealth.operators.keyed import newest_rows
from stockhealth.operators.metrics import ROUNDED_COLUMNS, ROW_TIES, SCORE_TIES, score_rounded
from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import PAIR


def last_n(
    daily: DataFrame, policy: Policy = DEFAULT_POLICY, ties: list[str] = SCORE_TIES, since: date | None = None
) -> DataFrame:
    """The newest 14 rows per pair; ``day_num`` ascends with the date (the slope ignores its origin)."""
    newest = newest_rows(daily.select(*PAIR, "date", *ties), PAIR, ties, policy.history_rows, since)
    return newest.withColumn("day_num", (-F.col("rn")).cast("long"))


def _slope() -> Column:
    """Least squares in closed form; a row without ``issued`` still counts in n and in the x sums."""
    x, y = F.col("day_num"), F.col("issued")
    n, sum_x = F.count(F.lit(1)), F.sum(x)
    return F.try_divide(
        (n * F.sum(x * y) - sum_x * F.sum(y)).cast("double"), (n * F.sum(x * x) - sum_x * sum_x).cast("double")
    )


def trend(daily: DataFrame, policy: Policy = DEFAULT_POLICY, since: date | None = None) -> DataFrame:
    return last_n(daily, policy, since=since).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("history_rows"), F.avg("issued").alias("avg_issued"), _slope().alias("trend_slope")
    )


def _forecast(average: Column, slope: Column, policy: Policy) -> Column:
    raw = average + F.coalesce(policy.horizon_days * slope, F.lit(0.0))
    return F.when(raw > 0, F.bround(raw, 2))


def forecast(daily: DataFrame, policy: Policy = DEFAULT_POLICY, since: date | None = None) -> DataFrame:
    """Average plus the trend carried 7 days; null when there is no positive demand."""
    return trend(daily, policy, since).select(
        *PAIR, _forecast(F.col("avg_issued"), F.col("trend_slope"), policy).alias("ml_forecasted_demand")
    )


def estimated_demand(forecasted: Column, average: Column) -> Column:
    return F.coalesce(forecasted, average)


def metrics_forecast(daily: DataFrame, policy: Policy = DEFAULT_POLICY, since: date | None = None) -> DataFrame:
    """Rounded metrics recomputed on the estimated demand.

    The newest 14 rows feed both the trend and (the first 7 of them) the rolling mean, so one pass
    and one exchange serve both; no join.
    """
    in_window = F.col("rn") <= policy.window_rows
    usage = (
        last_n(daily, policy, ROW_TIES, since)
        .groupBy(*PAIR)
        .agg(
            F.min_by(F.struct("date", *ROW_TIES), "rn").alias("last"),
            F.bround(F.avg(F.when(in_window, F.col("issued"))), 2).alias("avg_daily_issue"),
            F.avg("issued").alias("_avg"), _slope().alias("_slope"),
        )
        .withColumn("ml_forecasted_demand", _forecast(F.col("_avg"), F.col("_slope"), policy))
        .select(
            *PAIR, "last.*", "avg_daily_issue", "ml_forecasted_demand",
            estimated_demand(F.col("ml_forecasted_demand"), F.col("avg_daily_issue")).alias("estimated_daily_demand"),
        )
    )
    return score_rounded(usage, policy).select(*ROUNDED_COLUMNS)


def attach_forecast(snapshot: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Add forecast columns to a ready snapshot; its other columns stay as they are."""
    if "ml_forecasted_demand" in snapshot.columns:
        return snapshot
    joined = snapshot.join(forecasts.select(*PAIR, "ml_forecasted_demand"), PAIR, "left")
    joined = joined.select(*snapshot.columns, "ml_forecasted_demand")
    if "estimated_daily_demand" in snapshot.columns:
        return joined
    average = F.col("avg_daily_issue") if "avg_daily_issue" in snapshot.columns else F.lit(0.0)
    return joined.withColumn("estimated_daily_demand", estimated_demand(F.col("ml_forecasted_demand"), average))


def forecast_compare(snapshot: DataFrame) -> DataFrame:
    """Forecast against the simple average, for pairs that have one."""
    average, predicted = F.coalesce(F.col("avg_daily_issue"), F.lit(0.0)), F.col("ml_forecasted_demand")
    return snapshot.where(predicted > 0).select(
        *PAIR, average.alias("avg_daily_issue"), "ml_forecasted_demand",
        F.coalesce(F.col("estimated_daily_demand"), F.lit(0.0)).alias("estimated_daily_demand"),
        F.bround(F.try_divide(predicted - average, average) * 100, 1).alias("forecast_change"),
    )
