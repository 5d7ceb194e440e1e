"""Action log: writing with defaults, reading, summaries and export logging."""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockhealth.functions import columns as C
from stockhealth.operators import reports
from stockhealth.operators.keyed import with_position
from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import ACTION_LOGS, PAIR

UNKNOWN_USER = "unknown_user"
LOCAL_USER = "local_user"

def newest_actions() -> list[Column]:
    return [F.col("action_timestamp").desc_nulls_last(), F.col("action_id").desc()]


def clock(as_of: datetime | Column | None) -> Column:
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def user_or_default(user: str | None, connected: bool = True) -> Column:
    """The given user, else the session's user; without a session a local name."""
    if user:
        return F.lit(user)
    return F.coalesce(F.current_user(), F.lit(UNKNOWN_USER)) if connected else F.lit(LOCAL_USER)


def log_actions(
    new: DataFrame,
    existing: DataFrame | None = None,
    order: list[Column] | None = None,
    user: str | None = None,
    as_of: datetime | Column | None = None,
    id_at: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Complete a batch of actions: next ids, time, user and status PENDING where not given.

    Ids continue after the highest one in ``existing`` and follow ``order`` without gaps; ``order``
    may use columns of ``new`` that the log does not keep. One writer at a time may append to such a log.
    With ``id_at`` ids come from the position in ``order`` instead (``tables.append_as_writer``).
    """
    absent = [f for f in ACTION_LOGS.fields if f.name not in new.columns and f.name != "action_id"]
    padded = new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})
    filled = padded.withColumns({
        "action_timestamp": F.coalesce(F.col("action_timestamp").cast("timestamp_ntz"), clock(as_of)),
        "user_id": F.coalesce(F.col("user_id"), user_or_default(user)),
        "status": F.coalesce(F.col("status"), F.lit("PENDING")),
    })
    order = order or [F.col(c).asc_nulls_last() for c in ("action_timestamp", "location", "item", "action_type")]
    if id_at is None:
        start = F.lit(0) if existing is None else F.coalesce(existing.agg(F.max("action_id")).scalar(), F.lit(0))
        id_at = lambda n: start + n
    numbered = with_position(filled, order, "_n").withColumn("action_id", id_at(F.col("_n")))
    return numbered.select(*[F.col(f.name).cast(f.dataType) for f in ACTION_LOGS.fields])


def parse_details(actions: DataFrame) -> DataFrame:
    """JSON text to VARIANT, for writing; malformed text is kept as null."""
    return actions.withColumn("action_details", F.try_parse_json("action_details"))


def render_details(actions: DataFrame) -> DataFrame:
    """VARIANT back to JSON text, empty when there is none."""
    return actions.withColumn("action_details", F.coalesce(F.to_json("action_details"), F.lit("")))


def detail(field: str, type_name: str = "string") -> Column:
    return F.try_variant_get(F.col("action_details"), f"$.{field}", type_name)


def stock_entry_details(user: Column | str) -> Column:
    """Details of a manual stock entry, from the columns of the row."""
    return F.to_json(F.struct(
        F.lit("manual_input").alias("source"), F.col("date").cast("string").alias("date"),
        "opening_stock", "received", "issued", "closing_stock",
        (user if isinstance(user, Column) else F.lit(user)).alias("entered_by"),
    ), {"ignoreNullFields": "false"})


def upload_details(uploaded: DataFrame, user: str, file_name: str) -> DataFrame:
    """The single action that records a CSV upload."""
    return uploaded.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("CREATE_PO").alias("action_type"), F.lit("COMPLETED").alias("status"), F.lit(user).alias("user_id"),
        F.to_json(F.struct(
            F.lit("csv_upload").alias("source"), F.col("n").alias("rows_uploaded"),
            F.lit(user).alias("uploaded_by"), F.lit(file_name).alias("file_name"),
        )).alias("action_details"),
    )


def load_actions(actions: DataFrame, limit: int = 100, user: str | None = None) -> DataFrame:
    chosen = actions if user is None else actions.where(F.col("user_id") == user)
    return chosen.orderBy(*newest_actions()).limit(limit)


def recent_actions(
    actions: DataFrame, as_of: datetime | Column | None = None, policy: Policy = DEFAULT_POLICY
) -> DataFrame:
    """The last 24 hours before ``as_of``, newest first."""
    since = clock(as_of) - F.make_dt_interval(hours=F.lit(policy.recent_hours))
    if "action_date" in actions.columns:  # the folder column of a stored log
        actions = actions.where(F.col("action_date") >= F.to_date(since))
    return actions.where(F.col("action_timestamp") >= since).orderBy(*newest_actions()).select(
        "action_id", "action_timestamp", "user_id", "action_type", "location", "item", "priority",
        "days_of_cover", "suggested_reorder", "status", "action_details",
    )


def summary_order() -> list[Column]:
    return [F.col("action_count").desc(), F.col("action_type").asc_nulls_last()]


def action_summary(actions: DataFrame) -> DataFrame:
    """Per type: how many, on how many pairs, first and last. A pair with a null half is not counted.

    Distinct pairs are reduced per (type, pair) first, then counted, so a type holding most of the
    log still spreads over the cluster.
    """
    pair = F.concat(F.col("location"), F.lit("|"), F.col("item")).alias("pair")
    per_pair = actions.groupBy("action_type", pair).agg(
        F.count(F.lit(1)).alias("n"), F.min("action_timestamp").alias("first"), F.max("action_timestamp").alias("last")
    )
    return per_pair.groupBy("action_type").agg(
        F.sum("n").alias("action_count"), F.count("pair").alias("unique_items_acted_upon"),
        F.min("first").alias("first_action"), F.max("last").alias("last_action"),
    ).orderBy(*summary_order())


def pending_order() -> list[Column]:
    return [C.priority_rank(F.col("priority")).asc(), *newest_actions()]


def pending_actions(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("status") == "PENDING").orderBy(*pending_order()).select(
        "action_id", "action_timestamp", "user_id", "action_type", "location", "item", "priority",
        "days_of_cover", "suggested_reorder", "action_details",
    )


def action_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.coalesce(F.sum("action_count"), F.lit(0)).alias("total_actions"), F.count(F.lit(1)).alias("action_types")
    )


def _export_details(kind: str, count_name: str, total: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("export_type"), total.alias(count_name)))


def log_po_export(orders: DataFrame) -> DataFrame:
    """One completed EXPORT_CSV action per purchase order, for ``log_actions`` with ``po_export_order``.

    The log does not record the days left of an order; they are carried for the order only.
    """
    total = orders.agg(F.count(F.lit(1))).scalar()
    return orders.withColumn("_total", total).select(
        F.lit("EXPORT_CSV").alias("action_type"), F.lit("COMPLETED").alias("status"), *PAIR, "priority",
        F.col("days_of_cover").alias("_days_left"),
        "suggested_reorder", _export_details("purchase_orders", "total_pos", F.col("_total")).alias("action_details"),
    )


def po_export_order() -> list[Column]:
    return [
        C.priority_rank(F.col("priority")).asc(), F.col("_days_left").asc_nulls_last(),
        F.col("location").asc_nulls_last(), F.col("item").asc_nulls_last(),
    ]


def log_priority_export(at_risk: DataFrame, first: int = 10) -> DataFrame:
    """Completed EXPORT_CSV actions for the ten most urgent pairs of an exported list."""
    total = at_risk.agg(F.count(F.lit(1))).scalar()
    return at_risk.orderBy(*reports.risk_order()).limit(first).withColumn("_total", total).select(
        F.lit("EXPORT_CSV").alias("action_type"), F.lit("COMPLETED").alias("status"), *PAIR, "priority",
        "days_of_cover", "suggested_reorder",
        _export_details("priority_list", "total_items", F.col("_total")).alias("action_details"),
    )


def enrich_actions(actions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Give each action its pair's days of cover and reorder; actions on unknown pairs are left out.

    The snapshot has one row per pair, so a pair with many actions is a one-to-many join that the
    adaptive skew rule splits.
    """
    facts = snapshot.select(*PAIR, "days_of_cover", "suggested_reorder")
    kept = [c for c in actions.columns if c not in ("days_of_cover", "suggested_reorder")]
    return actions.select(*kept).join(facts, PAIR).select(*kept, "days_of_cover", "suggested_reorder")


def refused_actions(actions: DataFrame, snapshot: DataFrame) -> DataFrame:
    return actions.join(snapshot.select(*PAIR), PAIR, "left_anti").select(*actions.columns)
