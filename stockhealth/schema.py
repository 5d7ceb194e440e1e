"""Table schemas, keys and enumerations."""
from __future__ import annotations

from pyspark.sql import types as T

PAIR = ["location", "item"]
STOCK_KEY = ["date", "location", "item"]

STOCK_DAILY = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("location", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("opening_stock", T.LongType()),
    T.StructField("received", T.LongType()),
    T.StructField("issued", T.LongType()),
    T.StructField("closing_stock", T.LongType()),
    T.StructField("lead_time_days", T.LongType()),
])

METRIC_COLUMNS = [
    "date", "location", "item", "closing_stock", "avg_daily_issue", "days_of_cover",
    "lead_time_days", "status", "suggested_reorder", "urgency_score", "priority",
    "potential_waste", "optimal_stock",
]

NUMERIC_METRICS = [
    "closing_stock", "avg_daily_issue", "days_of_cover", "lead_time_days",
    "suggested_reorder", "urgency_score", "potential_waste", "optimal_stock",
]

ACTION_LOGS = T.StructType([
    T.StructField("action_id", T.LongType()),
    T.StructField("action_timestamp", T.TimestampNTZType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("action_details", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("days_of_cover", T.DoubleType()),
    T.StructField("suggested_reorder", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

STOCK_CHANGES = T.StructType([
    T.StructField("change_timestamp", T.TimestampNTZType()),
    T.StructField("location", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("change_type", T.StringType()),
    T.StructField("closing_stock", T.LongType()),
])

ALERT_OBSERVATIONS = T.StructType([
    T.StructField("action_id", T.LongType()),
    T.StructField("alert_timestamp", T.TimestampNTZType()),
    T.StructField("location", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("days_of_cover", T.DoubleType()),
    T.StructField("suggested_reorder", T.DoubleType()),
])

CRITICAL_ALERTS = T.StructType([
    T.StructField("alert_timestamp", T.TimestampNTZType()),
    T.StructField("location", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("days_of_cover", T.DoubleType()),
    T.StructField("closing_stock", T.LongType()),
    T.StructField("suggested_reorder", T.DoubleType()),
])

# The data contract's enumerations.
STATUSES = ["red", "orange", "green", "unknown"]
PRIORITIES = ["Critical", "High", "Medium", "Low", "Unknown"]
ACTION_TYPES = ["EXPORT_CSV", "VIEW_DETAILS", "ACKNOWLEDGE_ALERT", "CREATE_PO", "DISMISS_ALERT"]
ACTION_STATUSES = ["PENDING", "COMPLETED", "CANCELLED"]
