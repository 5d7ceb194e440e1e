"""The query catalogue: every operator applied to the inputs derived from the sales tables."""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockhealth.functions import columns as C
from stockhealth.functions.sql_functions import register_text_functions
from stockhealth.operators import actions as A
from stockhealth.operators import changes, forecast as FC, metrics as M, narrative as N, reports as R
from stockhealth.operators.keyed import with_position
from stockhealth.plans import inputs
from stockhealth.schema import PAIR, STOCK_DAILY
from stockhealth.session import pin, shared_path
from stockhealth.sources import contracts, tables
from stockhealth.streaming import queries as S
from stockhealth.streaming.history import RefreshLog, read_history, refresh_status

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

# A dashboard user's picks, valid at every scale.
PICKED_LOCATION, PICKED_ITEM = "Supplier#000000001", "PROMO"
PICKED_ITEMS = ["ECONOMY", "PROMO", "SMALL"]
RISK_THRESHOLD = 7.5


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, the precision compared against the oracle."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(spark, sf_dir))

        CATALOG[name] = run
        return run

    return register


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.stock_daily(spark, sf_dir)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.metrics(_daily(spark, sf_dir))


def _at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.at_risk(_metrics(spark, sf_dir))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.action_logs(spark, sf_dir)


def on(source: Query, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    query(name)(lambda spark, sf_dir: fn(source(spark, sf_dir)))


def _few(df: DataFrame, order: list[Column]) -> DataFrame:
    """Positions of a list that a limit has already made short."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


# --- sources, sinks, contracts ---------------------------------------------------------------

@query("src_csv")
def _src_csv(spark, sf_dir):
    path = shared_path(spark, "stock-csv")
    tables.export_csv(_daily(spark, sf_dir), path)
    return tables.read_stock_csv(spark, path)


@query("src_table")
def _src_table(spark, sf_dir):
    path = shared_path(spark, "stock-upper")
    daily = _daily(spark, sf_dir)
    daily.toDF(*[c.upper() for c in daily.columns]).write.parquet(path)
    return tables.read_table(spark, path)


@query("src_coerce")
def _src_coerce(spark, sf_dir):
    text = _metrics(spark, sf_dir).select(
        *PAIR, F.col("closing_stock").cast("string").alias("closing_stock"),
        F.when(F.col("status") == "red", "n/a").otherwise(F.col("avg_daily_issue").cast("string")).alias("avg_daily_issue"),
        F.concat(F.col("lead_time_days").cast("string"), F.when(F.col("lead_time_days") % 2 == 1, " days").otherwise(""))
        .alias("lead_time_days"),
    )
    return tables.coerce_numeric(text)


@query("src_resolve")
def _src_resolve(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    view = shared_path(spark, "metrics").rsplit("/", 1)[1].replace("-", "_")
    snapshot = M.metrics(daily)
    snapshot.toDF(*[c.upper() for c in snapshot.columns]).createOrReplaceTempView(view)
    resolved, source = tables.resolve_metrics(spark, daily, table=f"{view}_dt", view=view)
    spark.catalog.dropTempView(view)
    return resolved.withColumn("source", F.lit(source))


@query("ingest_validate")
def _ingest_validate(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    path = shared_path(spark, "upload")
    digit = inputs.suppkey_of(F.col("location")) % 10
    text = daily.withColumns({
        "issued": F.when(digit == 3, "n/a").otherwise(F.col("issued").cast("string")),
        "date": F.when(digit == 4, "soon").otherwise(F.col("date").cast("string")),
    }).drop("received")
    tables.export_csv(text, path)
    return contracts.validate_upload(tables.read_upload_csv(spark, path))


def _spoiled_upload(daily: DataFrame, path: str) -> None:
    """Lines without a header; of every ten suppliers one has a bad number, one a bad day, one a field too few and one a field too many."""
    digit = inputs.suppkey_of(F.col("location")) % 10
    fields = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STOCK_DAILY.names}
    fields["issued"] = F.when(digit == 3, "n/a").otherwise(fields["issued"])
    fields["date"] = F.when(digit == 4, "soon").otherwise(fields["date"])
    line = F.concat_ws(",", *[fields[c] for c in STOCK_DAILY.names])
    short = F.concat_ws(",", *[fields[c] for c in STOCK_DAILY.names[:-1]])
    daily.select(F.when(digit == 5, short).when(digit == 6, F.concat(line, F.lit(",x"))).otherwise(line)).write.text(path)


@query("ingest_quarantine")
def _ingest_quarantine(spark, sf_dir):
    """The bad lines of an upload with their reasons, and how many rows of each location went on."""
    path, stock, bad = (shared_path(spark, f"upload-{n}") for n in ("in", "stock", "bad"))
    _spoiled_upload(_daily(spark, sf_dir), path)
    tables.load_upload(spark, path, stock, bad, STOCK_DAILY.names)
    good = tables.read_stock(spark, stock).groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    lines = spark.read.parquet(bad).select("line", "reason", F.lit(None).cast("long").alias("n"))
    return lines.unionByName(good.select(F.col("location").alias("line"), F.lit("loaded").alias("reason"), "n"))


@query("src_seed")
def _src_seed(spark, sf_dir):
    """The table holds other rows before; the seed replaces them."""
    source, path = shared_path(spark, "seed-csv"), shared_path(spark, "seeded")
    daily = _daily(spark, sf_dir)
    tables.export_csv(daily, source)
    tables.append_stock(daily.where("item = 'PROMO'"), path)
    tables.seed(spark, source, path)
    return tables.read_stock(spark, path)


@query("ingest_append")
def _ingest_append(spark, sf_dir):
    path = shared_path(spark, "stock")
    daily = _daily(spark, sf_dir)
    first = F.year("date") < 1997
    tables.append_stock(daily.where(first), path)
    tables.append_stock(daily.where(~first), path)
    return tables.read_stock(spark, path)


@query("export_priority")
def _export_priority(spark, sf_dir):
    path = shared_path(spark, "at-risk-priority")
    at_risk = _at_risk(spark, sf_dir)
    tables.export_priority(at_risk, path)
    return spark.read.schema(at_risk.schema).option("header", True).csv(path)


@query("export_po")
def _export_po(spark, sf_dir):
    path = shared_path(spark, "purchase-orders")
    tables.export_po(R.purchase_orders(_at_risk(spark, sf_dir)), path)
    schema = "priority string, item string, location string, suggested_reorder double, lead_time_days long"
    return spark.read.schema(schema).option("header", True).csv(path)


on(_metrics, "dq_contract", contracts.check_contract)
on(_daily, "dq_profile", contracts.profile)


@query("dq_row_counts")
def _dq_row_counts(spark, sf_dir):
    daily, log = _daily(spark, sf_dir), _actions(spark, sf_dir)
    snapshot = M.metrics(daily)
    return contracts.row_counts({
        "stock_daily": daily, "inventory_metrics": snapshot, "inventory_at_risk": M.at_risk(snapshot),
        "action_logs": log, "critical_items_alerts": inputs.existing_alerts(log),
    })


@query("dq_footers")
def _dq_footers(spark, sf_dir):
    """Counts and dates of the stored ledger and action log, by their Parquet footers."""
    paths = {name: shared_path(spark, name.replace("_", "-")) for name in ("stock_daily", "action_logs")}
    tables.append_stock(_daily(spark, sf_dir), paths["stock_daily"])
    tables.append_actions(_actions(spark, sf_dir), paths["action_logs"])
    return contracts.footer_profile(spark, paths)


@query("dq_enums")
def _dq_enums(spark, sf_dir):
    spoiled = _actions(spark, sf_dir).withColumns({
        "action_type": F.when(F.col("user_id").endswith("7"), "TEST_ACTION").otherwise(F.col("action_type")),
        "status": F.when(F.col("action_id") % 11 == 0, "DONE").otherwise(F.col("status")),
    })
    return contracts.check_enums(spoiled)


# --- metrics ---------------------------------------------------------------------------------

on(_daily, "rolling_issue", lambda d: M.rolling_issue(d).select(*PAIR, "date", "issued", "avg_daily_issue"))
on(_metrics, "days_of_cover", lambda m: m.select(*PAIR, "closing_stock", "avg_daily_issue", "days_of_cover"))
on(_metrics, "status_band", lambda m: m.select(*PAIR, "days_of_cover", "status"))
on(_metrics, "suggested_reorder", lambda m: m.select(*PAIR, "suggested_reorder"))
on(_metrics, "urgency_score", lambda m: m.select(*PAIR, "urgency_score"))
on(_metrics, "priority", lambda m: m.select(*PAIR, "days_of_cover", "lead_time_days", "priority"))
on(_metrics, "potential_waste", lambda m: m.select(*PAIR, "potential_waste"))
on(_metrics, "optimal_stock", lambda m: m.select(*PAIR, "lead_time_days", "optimal_stock"))
on(_daily, "latest_per_pair", M.latest_per_pair)
on(_daily, "metrics", M.metrics)
on(_metrics, "at_risk", M.at_risk)
on(_daily, "metrics_history", M.metrics_history)
on(_metrics, "quick_priority", lambda m: m.select(
    *PAIR, C.quick_priority(F.col("days_of_cover"), F.col("lead_time_days")).alias("priority")))
on(_daily, "metrics_rounded", M.metrics_rounded)
on(_metrics, "band", lambda m: m.select(
    *PAIR, "days_of_cover",
    C.band(F.col("days_of_cover"), [2, 5], ["red", "orange", "green"], "unknown").alias("band")))

# --- forecast --------------------------------------------------------------------------------

on(_daily, "last_n", lambda d: FC.last_n(d).select(*PAIR, "date", "issued", "day_num"))
on(_daily, "trend_slope", FC.trend)
on(_daily, "forecast", FC.forecast)
on(_daily, "est_demand", lambda d: FC.metrics_forecast(d).select(
    *PAIR, "avg_daily_issue", "ml_forecasted_demand", "estimated_daily_demand"))
on(_daily, "metrics_forecast", FC.metrics_forecast)
on(_daily, "attach_forecast", lambda d: FC.attach_forecast(M.metrics(d), FC.forecast(d)))
on(_daily, "forecast_compare", lambda d: FC.forecast_compare(FC.attach_forecast(M.metrics(d), FC.forecast(d))))

# --- reports ---------------------------------------------------------------------------------

on(_metrics, "kpis", R.kpis)
on(_metrics, "location_health", lambda m: with_position(R.location_health(m), R.location_order()))
on(_metrics, "item_health", lambda m: with_position(R.item_health(m), R.item_order()))
on(_metrics, "dims", lambda m: with_position(R.dims(m), R.dims_order()))


@query("slice_metrics")
def _slice_metrics(spark, sf_dir):
    solvent = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0").select("s_name")
    return R.slice_metrics(_metrics(spark, sf_dir), solvent, PICKED_ITEMS)


on(_metrics, "quick_actions", lambda m: _few(R.quick_actions(m), R.risk_order()))
on(_metrics, "at_risk_list", lambda m: with_position(R.at_risk_list(m, RISK_THRESHOLD), R.risk_order()))
on(_at_risk, "priority_counts", R.priority_counts)
on(_metrics, "priority_rank", lambda m: R.priority_ranks(m).withColumn("priority_rank", F.col("priority_rank").cast("long")))
on(_metrics, "waste_summary", R.waste_summary)
on(_metrics, "overstock", lambda m: with_position(R.overstock(m), R.waste_order()))
on(_at_risk, "purchase_orders", lambda m: with_position(R.purchase_orders(m), R.risk_order()))
on(_metrics, "heatmap_long", R.heatmap_long)
on(_metrics, "heatmap_wide", R.heatmap_wide)
on(_daily, "trend_change", R.trend_change)
on(_daily, "trend_direction", R.trend_direction)
on(_daily, "trend_series", lambda d: with_position(R.trend_series(d, PICKED_LOCATION, PICKED_ITEM), [F.col("date").asc()]))
on(_daily, "inventory_status", lambda d: R.inventory_status(d, M.metrics(d)))
on(_daily, "usage_status", lambda d: R.usage_status(d, M.metrics(d)))
on(_metrics, "po_status", R.po_status)

# --- action log ------------------------------------------------------------------------------


@query("log_actions")
def _log_actions(spark, sf_dir):
    log = _actions(spark, sf_dir)
    new = _at_risk(spark, sf_dir).select(
        F.lit("ACKNOWLEDGE_ALERT").alias("action_type"), *PAIR, "priority", "days_of_cover", "suggested_reorder")
    order = [F.col("location").asc(), F.col("item").asc()]
    return A.log_actions(new, log, order, user=A.LOCAL_USER, as_of=inputs.latest_timestamp(log))


@query("log_actions_writers")
def _log_actions_writers(spark, sf_dir):
    """Two writers append to one log at the same time: no id twice, ids ascend within a batch."""
    log = pin(_actions(spark, sf_dir).withColumnRenamed("action_id", "_given").drop("user_id"), "batch")
    path = shared_path(spark, "writers")

    def write(n: int) -> None:
        tables.append_as_writer(log.where(F.col("_given") % 2 == n), path, [F.col("_given").asc()], user=f"writer_{n}", block=1000)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    both = tables.read_actions(spark, path)
    repeated = both.groupBy("action_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()
    placed = with_position(both, [F.col("user_id").asc(), F.col("action_id").asc()])
    return placed.select("pos", "user_id", "action_type", *PAIR, "status", repeated.alias("repeated_ids"))


on(_actions, "action_json", lambda a: A.render_details(
    A.parse_details(a).select("action_id", A.detail("k", "long").alias("k"), "action_details")))
on(_daily, "action_details_build", lambda d: d.select(
    *PAIR, "date", A.stock_entry_details(A.LOCAL_USER).alias("action_details")))
on(_actions, "actions_top_n", lambda a: _few(A.load_actions(a, 50), A.newest_actions()))
on(_actions, "recent_actions", lambda a: with_position(
    A.recent_actions(a, inputs.latest_timestamp(a)), A.newest_actions()))
on(_actions, "action_summary", lambda a: with_position(A.action_summary(a), A.summary_order()))
on(_actions, "pending_actions", lambda a: with_position(A.pending_actions(a), A.pending_order()))
on(_actions, "action_totals", lambda a: A.action_totals(A.action_summary(a)))


@query("log_po_export")
def _log_po_export(spark, sf_dir):
    log = _actions(spark, sf_dir)
    rows = A.log_po_export(R.purchase_orders(_at_risk(spark, sf_dir)))
    return A.log_actions(rows, log, A.po_export_order(), user=A.LOCAL_USER, as_of=inputs.latest_timestamp(log))


@query("log_priority_export")
def _log_priority_export(spark, sf_dir):
    log = _actions(spark, sf_dir)
    rows = A.log_priority_export(_at_risk(spark, sf_dir))
    return A.log_actions(rows, log, R.risk_order(), user=A.LOCAL_USER, as_of=inputs.latest_timestamp(log))


query("enrich_actions")(lambda spark, d: A.enrich_actions(_actions(spark, d), _metrics(spark, d)))
query("refused_actions")(lambda spark, d: A.refused_actions(_actions(spark, d), _metrics(spark, d)))

# --- narrative -------------------------------------------------------------------------------

on(_metrics, "risk_lines", lambda m: N.risk_lines(m, "red").unionByName(N.risk_lines(m, "orange")))
on(_metrics, "summary_prompt", N.summary_prompt)
on(_metrics, "summary_prompt_lines", N.summary_prompt_lines)


@query("text_functions")
def _text_functions(spark, sf_dir):
    """Both texts by the catalog's SQL functions, for all pairs and some that are not in the snapshot."""
    snapshot = pin(_metrics(spark, sf_dir), "metrics")
    register_text_functions(snapshot)
    snapshot.select(*PAIR).createOrReplaceTempView("asked_pairs")
    return spark.sql("""
        SELECT location, item, explain_reorder(location, item) AS text FROM asked_pairs
        UNION ALL SELECT location, concat(item, ' (old)'), explain_reorder(location, concat(item, ' (old)')) FROM asked_pairs
        UNION ALL SELECT 'all', 'all', inventory_summary_prompt()""")


@query("explain_reorder")
def _explain_reorder(spark, sf_dir):
    snapshot = _metrics(spark, sf_dir)
    asked = snapshot.select(*PAIR)
    unknown = asked.where(inputs.suppkey_of(F.col("location")) % 10 == 0).select(
        "location", F.concat(F.col("item"), F.lit(" (old)")).alias("item"))
    return N.explain_reorder(snapshot, asked.unionByName(unknown))


on(_metrics, "explain_critical", lambda m: with_position(N.explain_critical(m), N.line_order()))
on(_at_risk, "fallback_summary", N.fallback_summary)


@query("daily_summary")
def _daily_summary(spark, sf_dir):
    path = shared_path(spark, "daily-summaries")
    now = inputs.latest_timestamp(_actions(spark, sf_dir))
    tables.append_summary(N.daily_summary(_at_risk(spark, sf_dir), now, now), path)
    return spark.read.parquet(path)


# --- change capture and streaming ------------------------------------------------------------

on(_daily, "snapshot_diff", lambda d: changes.snapshot_diff(*inputs.snapshot_pair(d)))
on(_daily, "change_log", lambda d: changes.change_log(inputs.change_feed(d)))


@query("diff_versions")
def _diff_versions(spark, sf_dir):
    """Two stored versions that differ in every other quarter; a day of the stored tables is the first of its quarter."""
    old, new = inputs.snapshot_pair(pin(_daily(spark, sf_dir), "ledger"))
    quarterly = lambda df: df.withColumns({"item": F.concat("item", F.lit(" "), F.col("date").cast("string")), "date": F.trunc("date", "quarter")})
    old, new, touched = quarterly(old), quarterly(new), F.quarter("date") % 2 == 0
    before, after = shared_path(spark, "version"), shared_path(spark, "version")
    changes.save_version(old, before)
    changes.save_version(old.where(~touched).unionByName(new.where(touched)), after)
    return changes.diff_versions(spark, before, after)


@query("diff_change_log")
def _diff_change_log(spark, sf_dir):
    """A first load and a second version, captured as row changes and logged."""
    old, new = inputs.snapshot_pair(pin(_daily(spark, sf_dir), "ledger"))
    now = inputs.latest_timestamp(_actions(spark, sf_dir))
    first = changes.changes_from_diff(changes.snapshot_diff(old.where("false"), old), now)
    later = changes.changes_from_diff(changes.snapshot_diff(old, new), now + F.make_dt_interval(hours=F.lit(1)))
    return changes.change_log(first.unionByName(later))


@query("new_alerts")
def _new_alerts(spark, sf_dir):
    log = _actions(spark, sf_dir)
    return changes.new_alerts(_metrics(spark, sf_dir), inputs.existing_alerts(log), inputs.latest_timestamp(log))


def _staged(df: DataFrame, name: str, files: int = 4) -> tuple[str, str, str]:
    """Write a stream's source folder; returns source, target and checkpoint paths."""
    spark = df.sparkSession
    source = shared_path(spark, name)
    df.repartition(files).write.parquet(source)  # rows of any time in every file
    return source, shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-state")


@query("stream_change_log")
def _stream_change_log(spark, sf_dir):
    source, target, state = _staged(inputs.change_feed(_daily(spark, sf_dir)), "changes")
    S.stream_change_log(spark, source, target, state, max_files=1).awaitTermination()
    return S.current_change_log(spark, target)


@query("stream_alerts")
def _stream_alerts(spark, sf_dir):
    source, target, state = _staged(inputs.alert_observations(_actions(spark, sf_dir)), "observations")
    S.stream_alerts(spark, source, target, state, max_files=1).awaitTermination()
    return S.current_alerts(spark, target)


_PARTS = 4  # buckets of the maintained tables: these have a few thousand pairs


def _refreshed(spark: SparkSession, sf_dir: str) -> str:
    source, target, state = _staged(_daily(spark, sf_dir), "stock-stream")
    S.stream_metrics(spark, source, target, state, max_files=1, buckets=_PARTS).awaitTermination()
    return target


query("stream_metrics")(lambda spark, d: S.current_metrics(spark, _refreshed(spark, d)))
query("stream_at_risk")(lambda spark, d: S.current_at_risk(spark, _refreshed(spark, d)))


# Refreshes: minutes after the data's own clock, days before its newest day up to which rows have arrived.
_REFRESHES = ((0, 90), (30, 60), (60, 30), (100, 0))


def _in_refreshes(spark: SparkSession, sf_dir: str, log: RefreshLog | None = None) -> tuple[str, list[dict]]:
    """A stock folder refreshed after each arrival, alerts included; the target folder and the progress."""
    daily = pin(_daily(spark, sf_dir), "ledger")
    now = _actions(spark, sf_dir).agg(F.max("action_timestamp")).first()[0]
    newest = daily.agg(F.max("date")).first()[0]
    source, target, state = (shared_path(spark, f"refreshed-{name}") for name in ("in", "out", "state"))
    history, after = [], date(1900, 1, 1)
    for minutes, back in _REFRESHES:
        until, at = newest - timedelta(days=back), now + timedelta(minutes=minutes)
        daily.where((F.col("date") > after) & (F.col("date") <= until)).write.mode("append").parquet(source)
        history += S.refresh(spark, source, target, state, alert_clock=lambda at=at: at, buckets=_PARTS, log=log, name="inventory_metrics_dt")
        after = until
    return target, history


query("alert_upkeep")(lambda spark, d: S.critical_alerts(spark, _in_refreshes(spark, d)[0]))
query("refresh_history")(lambda spark, d: S.refresh_history(spark, _in_refreshes(spark, d)[1])
                         .where("input_rows > 0").select("batch_id", "input_rows"))


def _history_table(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "refresh-history")
    _in_refreshes(spark, sf_dir, RefreshLog(spark, path))
    return path


@query("refresh_log")
def _refresh_log(spark, sf_dir):
    """The stored history of all refreshes: an epoch each, and the end of each run."""
    rows = read_history(spark, _history_table(spark, sf_dir)).where("batch_id IS NULL OR input_rows > 0")
    return rows.select("query_name", "state", "batch_id", "input_rows", F.col("error").isNotNull().alias("failed"))


@query("refresh_status")
def _refresh_status(spark, sf_dir):
    """Status half a minute after the last refresh, by the history alone."""
    history = read_history(spark, _history_table(spark, sf_dir)).where("batch_id IS NULL OR input_rows > 0")
    last = history.where("state = 'FINISHED'").agg(F.max("started_at") + F.make_dt_interval(secs=F.lit(30))).scalar()
    return refresh_status(history, last).select("query_name", "state", "epochs", "failures", "input_rows", "lag_seconds", "within_target")


@query("stream_rebuild")
def _stream_rebuild(spark, sf_dir):
    """A full refresh after half of the rows came through the stream, and one more epoch after it."""
    daily = pin(_daily(spark, sf_dir), "ledger")
    source, target, state = (shared_path(spark, f"rebuilt-{name}") for name in ("in", "out", "state"))
    part = F.pmod(F.hash("date"), F.lit(4))
    daily.where(part < 2).write.parquet(source)
    S.refresh(spark, source, target, state, buckets=_PARTS)
    daily.where(part == 2).write.mode("append").parquet(source)
    S.rebuild(spark, source, target, state, buckets=_PARTS)
    S.vacuum(spark, target)
    daily.where(part == 3).write.mode("append").parquet(source)
    S.refresh(spark, source, target, state, buckets=_PARTS)
    return S.current_metrics(spark, target)


@query("freshness")
def _freshness(spark, sf_dir):
    daily = _daily(spark, sf_dir)
    newest = daily.agg(F.max(F.col("date").cast("timestamp_ntz"))).scalar()
    kept = S.current_metrics(spark, _refreshed(spark, sf_dir))
    return S.freshness({"stock_daily": daily, "inventory_metrics": M.metrics(daily), "inventory_metrics_dt": kept}, newest)
