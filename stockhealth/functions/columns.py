"""Scoring rules as Column expressions (all JVM-side, all inside whole-stage codegen)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import PRIORITIES


def clamp_zero(value: Column) -> Column:
    """max(0, value), null in -> null out (``greatest`` alone would turn null into 0)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value.cast("double")))


def days_of_cover(closing: Column, demand: Column) -> Column:
    """closing / demand; null when demand is null or zero."""
    return F.try_divide(closing.cast("double"), demand)


def status_band(days: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return (
        F.when(days.isNull(), "unknown")
        .when(days < policy.red_days, "red")
        .when(days <= policy.orange_days, "orange")
        .otherwise("green")
    )


def band(value: Column, edges: Sequence[float], labels: Sequence[str], missing: str | None = None) -> Column:
    """Right-closed bands: label i covers (edges[i-1], edges[i]]; the last label is open above."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    expr = F.when(value.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels):
        expr = expr.when(value <= edge, label)
    return expr.otherwise(labels[-1])


def suggested_reorder(closing: Column, demand: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return clamp_zero(policy.target_days * F.coalesce(demand, F.lit(0.0)) - closing)


def urgency_score(days: Column, lead_time: Column) -> Column:
    return days - lead_time


def priority(days: Column, lead_time: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    urgent = (days - lead_time <= 0) | (days < policy.red_days) | (days <= lead_time + 1)
    return (
        F.when(days.isNull() | lead_time.isNull(), "Unknown")
        .when(days <= 0, "Critical")
        .when(urgent, "High")
        .when(days <= policy.orange_days, "Medium")
        .otherwise("Low")
    )


def quick_priority(days: Column, lead_time: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    """Short form for the quick list: everything past the urgent cases is Medium."""
    return (
        F.when(days.isNull() | lead_time.isNull(), "Unknown")
        .when(days <= 0, "Critical")
        .when((days - lead_time <= 0) | (days < policy.red_days), "High")
        .otherwise("Medium")
    )


def potential_waste(closing: Column, demand: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return clamp_zero(closing - policy.overstock_days * F.coalesce(demand, F.lit(0.0)))


def optimal_stock(lead_time: Column, demand: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return F.round((policy.target_days + lead_time) * F.coalesce(demand, F.lit(0.0)), 0)


def priority_rank(value: Column) -> Column:
    """0 for the most urgent; anything outside the list ranks with Unknown."""
    expr = F.when(value == PRIORITIES[0], 0)
    for rank, name in enumerate(PRIORITIES[1:-1], start=1):
        expr = expr.when(value == name, rank)
    return expr.otherwise(len(PRIORITIES) - 1)


def is_at_risk(days: Column, threshold: float) -> Column:
    return days.isNull() | (days <= threshold)


def decimal_text(value: Column, places: int = 1) -> Column:
    """Half-up text with a fixed number of places, as the warehouse's ROUND(x, n) || '' gives."""
    return F.round(value, places).cast(f"decimal(38,{places})").cast("string")


def printf_text(value: Column, places: int = 1) -> Column:
    """Text as '%.nf' gives it: the exact binary value, ties to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))
