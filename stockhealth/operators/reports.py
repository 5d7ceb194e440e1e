"""Dashboard reports over a metrics snapshot or the daily table.

Lists come back sorted; ``keyed.with_position`` numbers one by the orders given here.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockhealth.functions import columns as C
from stockhealth.operators.keyed import newest_first, oldest_first, top_rows
from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import PAIR, PRIORITIES


def _at_risk_count(policy: Policy) -> Column:
    return F.count_if(C.is_at_risk(F.col("days_of_cover"), policy.orange_days))


def location_order() -> list[Column]:
    return [F.col("critical_count").desc(), F.col("location").asc_nulls_last()]


def item_order() -> list[Column]:
    return [F.col("critical_locations").desc(), F.col("item").asc_nulls_last()]


def dims_order() -> list[Column]:
    return [F.col("dimension").asc(), F.col("value").asc()]


def waste_order() -> list[Column]:
    return [F.col("potential_waste").desc(), F.col("location").asc_nulls_last(), F.col("item").asc_nulls_last()]


def kpis(snapshot: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    totals = snapshot.agg(
        F.count(F.lit(1)).alias("total_items"),
        _at_risk_count(policy).alias("at_risk_items"),
        F.count_if(F.col("days_of_cover") < policy.red_days).alias("critical_items"),
    )
    healthy = F.col("total_items") - F.col("at_risk_items")
    return totals.withColumn("healthy_items", healthy).withColumn(
        "health_pct", F.coalesce(F.try_divide(healthy * 100.0, F.col("total_items")), F.lit(0.0))
    )


def location_health(snapshot: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return snapshot.groupBy("location").agg(
        _at_risk_count(policy).alias("at_risk_count"), F.count_if(F.col("status") == "red").alias("critical_count")
    ).orderBy(*location_order())


def item_health(snapshot: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return snapshot.groupBy("item").agg(
        _at_risk_count(policy).alias("at_risk_locations"),
        F.count_if(F.col("status") == "red").alias("critical_locations"),
        F.coalesce(F.sum("suggested_reorder"), F.lit(0.0)).alias("total_reorder"),
    ).orderBy(*item_order())


def dims(snapshot: DataFrame) -> DataFrame:
    """Distinct locations and items, sorted: the filter choices."""
    values = [
        snapshot.select(F.lit(c).alias("dimension"), F.col(c).alias("value")).where(F.col(c).isNotNull()).distinct()
        for c in PAIR
    ]
    return values[0].unionByName(values[1]).orderBy(*dims_order())


def slice_metrics(
    snapshot: DataFrame,
    locations: Sequence[str] | DataFrame | None = None,
    items: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Rows of the chosen locations and items; short lists are pushed to the scan, tables are semi-joined."""
    for column, chosen in zip(PAIR, (locations, items)):
        if chosen is None:
            continue
        if isinstance(chosen, DataFrame):
            picked = chosen.select(F.col(chosen.columns[0]).alias(column)).distinct()
            snapshot = snapshot.join(picked, column, "left_semi")
        else:
            snapshot = snapshot.where(F.col(column).isin(list(chosen)))
    return snapshot


def risk_order() -> list[Column]:
    """Most urgent first: priority, then days left, then the pair."""
    return [
        C.priority_rank(F.col("priority")).asc(), F.col("days_of_cover").asc_nulls_last(),
        F.col("location").asc_nulls_last(), F.col("item").asc_nulls_last(),
    ]


def quick_actions(snapshot: DataFrame, n: int = 5, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The n most urgent pairs with no more than two days left."""
    if "priority" not in snapshot.columns:
        snapshot = snapshot.withColumn(
            "priority", C.quick_priority(F.col("days_of_cover"), F.col("lead_time_days"), policy)
        )
    urgent = snapshot.where(C.is_at_risk(F.col("days_of_cover"), policy.red_days))
    return urgent.orderBy(*risk_order()).limit(n)


def at_risk_list(snapshot: DataFrame, threshold: float | None = None, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Pairs at or below the threshold, most urgent first; fills in priority and urgency when absent."""
    days, lead = F.col("days_of_cover"), F.col("lead_time_days")
    if "priority" not in snapshot.columns:
        snapshot = snapshot.withColumn("priority", C.priority(days, lead, policy))
    if "urgency_score" not in snapshot.columns:
        snapshot = snapshot.withColumn("urgency_score", F.coalesce(days, F.lit(0.0)) - F.coalesce(lead, F.lit(0)))
    limit = policy.orange_days if threshold is None else threshold
    lead_columns = ["priority", "location", "item", "days_of_cover", "lead_time_days", "urgency_score",
                    "closing_stock", "suggested_reorder"]
    demand = "estimated_daily_demand" if "estimated_daily_demand" in snapshot.columns else "avg_daily_issue"
    lead_columns += [c for c in ("ml_forecasted_demand", demand) if c in snapshot.columns]
    rest = [c for c in snapshot.columns if c not in lead_columns]
    return snapshot.where(C.is_at_risk(days, limit)).orderBy(*risk_order()).select(*lead_columns, *rest)


def priority_counts(at_risk: DataFrame) -> DataFrame:
    """One row for each of the four ranked priorities, zero included."""
    shown = PRIORITIES[:-1]
    counts = at_risk.agg(*[F.count_if(F.col("priority") == p).alias(p) for p in shown])
    return counts.unpivot([], shown, "priority", "n")


def priority_ranks(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(*PAIR, "priority", C.priority_rank(F.col("priority")).alias("priority_rank"))


def waste_summary(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(
        F.coalesce(F.sum("potential_waste"), F.lit(0.0)).alias("total_waste"),
        F.count_if(F.col("potential_waste") > 0).alias("overstocked_items"),
    )


def overstock(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(F.col("potential_waste") > 0).orderBy(*waste_order()).select(
        *PAIR, "closing_stock", "optimal_stock", "potential_waste"
    )


def purchase_orders(at_risk: DataFrame) -> DataFrame:
    """One order per (item, location) with something to order.

    Critical and High both become High; otherwise the priority and the lead time are those of the
    first row in at-risk order. All aggregates combine map-side.
    """
    rank = C.priority_rank(F.col("priority"))
    place = F.struct(rank, F.coalesce(F.col("days_of_cover"), F.lit(float("inf"))))
    lead = F.when(F.col("lead_time_days").isNotNull(), place)
    grouped = at_risk.groupBy("item", "location").agg(
        F.coalesce(F.sum("suggested_reorder"), F.lit(0.0)).alias("suggested_reorder"),
        F.when(F.bool_or(F.col("priority").isin("Critical", "High")), "High")
        .otherwise(F.min_by("priority", place)).alias("priority"),
        F.min("days_of_cover").alias("days_of_cover"),
        F.min_by("lead_time_days", lead).alias("lead_time_days"),
    )
    return grouped.where(F.col("suggested_reorder") > 0).orderBy(*risk_order()).select(
        "priority", "item", "location", "suggested_reorder", "days_of_cover", "lead_time_days"
    )


def heatmap_long(snapshot: DataFrame) -> DataFrame:
    extra = [c for c in ("ml_forecasted_demand", "estimated_daily_demand") if c in snapshot.columns]
    if "estimated_daily_demand" not in extra and "avg_daily_issue" in snapshot.columns:
        extra.append("avg_daily_issue")
    return snapshot.select(*PAIR, "status", "closing_stock", "days_of_cover", "suggested_reorder", *extra)


def heatmap_wide(snapshot: DataFrame, items: Sequence[str] | None = None) -> DataFrame:
    """Location by item matrix of statuses.

    Without ``items`` Spark looks the columns up and refuses more than spark.sql.pivotMaxValues;
    use ``heatmap_long`` for wider catalogues.
    """
    pivoted = snapshot.groupBy("location").pivot("item", list(items) if items is not None else None)
    return pivoted.agg(F.first("status", ignorenulls=True))


def trend_change(daily: DataFrame) -> DataFrame:
    """Latest against previous closing stock for every pair with two rows or more."""
    ties = ["closing_stock"]
    newest = top_rows(daily.select(*PAIR, "date", *ties), PAIR, newest_first("date", ties), 2)

    def at(rank: int) -> Column:
        return F.max(F.when(F.col("rn") == rank, F.col("closing_stock")))

    pairs = newest.groupBy(*PAIR).agg(
        at(1).alias("latest_stock"), at(2).alias("previous_stock"), F.count(F.lit(1)).alias("_n")
    )
    change, previous = F.col("latest_stock") - F.col("previous_stock"), F.col("previous_stock")
    return pairs.where("_n >= 2").drop("_n").withColumns({
        "stock_change": change,
        "change_pct": F.when(previous > 0, F.try_divide(change * 100.0, previous)).otherwise(0.0),
    })


def trend_direction(daily: DataFrame) -> DataFrame:
    """Mean of the last three closings against the first three, for pairs with three rows or more.

    Each row stands on both sides, with its place from that side, so one limited pass over one scan finds both ends.
    """
    day = F.unix_date("date")
    far = F.lit(1 << 40)
    ends = F.array(
        F.struct(F.lit(True).alias("recent"), F.coalesce(-day.cast("long"), far).alias("place"), (-F.col("closing_stock")).alias("tie")),
        F.struct(F.lit(False).alias("recent"), F.coalesce(day.cast("long"), -far).alias("place"), F.col("closing_stock").alias("tie")))
    sides = daily.select(*PAIR, "closing_stock", F.inline(ends))
    # Nulls are oldest: last among the recent, first among the earlier.
    order = [F.col("place").asc(), F.when(F.col("recent"), F.col("tie").isNull()).otherwise(F.col("tie").isNotNull()).asc(), F.col("tie").asc()]
    near = top_rows(sides, [*PAIR, "recent"], order, 3)
    pairs = near.groupBy(*PAIR).agg(
        F.avg(F.when(F.col("recent"), F.col("closing_stock"))).alias("recent_avg"),
        F.avg(F.when(~F.col("recent"), F.col("closing_stock"))).alias("earlier_avg"), F.count_if(F.col("recent")).alias("_n"))
    improving = F.coalesce(F.col("recent_avg") > F.col("earlier_avg"), F.lit(False))
    return pairs.where("_n >= 3").select(
        *PAIR, "recent_avg", "earlier_avg", F.when(improving, "Improving").otherwise("Declining").alias("direction")
    )


def trend_series(daily: DataFrame, location: str, item: str) -> DataFrame:
    """The daily series of one pair; the filter reaches the scan."""
    chosen = daily.where((F.col("location") == location) & (F.col("item") == item))
    return chosen.select("date", "closing_stock", "received", "issued", "opening_stock").orderBy("date")


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).alias(f"total_{column}")


def inventory_status(daily: DataFrame, snapshot: DataFrame) -> DataFrame:
    tracked = snapshot.agg(F.struct(
        F.count(F.lit(1)).alias("pairs"),
        F.count_distinct("location").alias("locations"),
        F.count_distinct("item").alias("items"),
    )).scalar()
    totals = daily.agg(
        _total("received"), _total("opening_stock"), _total("closing_stock"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    return totals.withColumn("_t", tracked).select(*totals.columns, "_t.*")


def usage_status(daily: DataFrame, snapshot: DataFrame) -> DataFrame:
    usage = snapshot.agg(F.struct(
        F.coalesce(F.avg("avg_daily_issue"), F.lit(0.0)).alias("avg_consumption"),
        F.count_if(F.col("avg_daily_issue") > 0).alias("items_with_usage"),
    )).scalar()
    totals = daily.agg(_total("issued"), F.count_distinct("date").alias("days_of_data"))
    return totals.withColumn("_u", usage).select(*totals.columns, "_u.*")


def po_status(snapshot: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Average lead time divides by all pairs, those without a lead time included."""
    total = F.sum("lead_time_days")
    return snapshot.agg(
        F.when(total > 0, F.try_divide(total.cast("double"), F.count(F.lit(1)))).otherwise(0.0).alias("avg_lead_time"),
        _at_risk_count(policy).alias("reorder_recommendations"),
        F.count("lead_time_days").alias("items_with_lead_time"),
    )
