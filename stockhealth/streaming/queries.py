"""Streaming queries: metrics upkeep, change log and alerts.

Sources are folders of Parquet files. Every query runs with ``availableNow`` unless given a trigger,
so an empty source starts no batch and a scheduler may call it as often as it likes. ``max_files``
bounds a micro-batch and changes no result.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from stockhealth.functions.columns import is_at_risk
from stockhealth.operators.actions import clock
from stockhealth.operators.changes import new_alerts
from stockhealth.operators.keyed import newest_first, top_rows
from stockhealth.operators.metrics import SCORE_TIES, metrics
from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import ALERT_OBSERVATIONS, CRITICAL_ALERTS, METRIC_COLUMNS, PAIR, STOCK_CHANGES, STOCK_DAILY
from stockhealth.streaming.history import RefreshLog
from stockhealth.streaming.keyed_state import ALERT_OUT, CHANGE_OUT, NEVER, NO_TIME, RUN, ChangeLog, Cooldown, TimedCooldown, packed

METRICS, AT_RISK, USAGE, DONE = "inventory_metrics_dt", "inventory_at_risk_dt", "recent_usage", "done"
ALERTS = "critical_items_alerts"
BUCKETS = 64  # parts of the maintained tables; an epoch reads and writes those of its pairs
KEYS = 1024  # buckets of pairs, the keys of the change log's state
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _files(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def _start(
    df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None, name: str | None = None
) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Version:
    """What a note in ``done`` says: the newest epoch in the tables, and which version of each bucket counts."""

    number: int
    epoch: int
    buckets: dict[int, int]


def newest_version(spark: SparkSession, target: str) -> Version | None:
    try:
        notes = spark.read.schema("epoch long, bucket int, bucket_version long, version long").parquet(f"{target}/{DONE}")
    except AnalysisException:  # nothing has been written yet
        return None
    number = notes.agg(F.max("version")).first()[0]
    rows = notes.where(F.col("version") == number).collect()  # one for each bucket
    return Version(number, rows[0]["epoch"], {r["bucket"]: r["bucket_version"] for r in rows if r["bucket"] is not None}) if rows else None


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*PAIR), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, target: str, name: str, schema: T.StructType, buckets: dict[int, int]) -> DataFrame:
    """The given versions of a table's buckets; no other folder is read."""
    whole = T.StructType([*schema, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
    if not buckets:
        return spark.createDataFrame([], whole)
    versions: dict[int, list[int]] = {}
    for bucket, version in buckets.items():
        versions.setdefault(version, []).append(bucket)
    root = f"{target}/{name}"
    table = spark.read.schema(whole).option("basePath", root).parquet(*[f"{root}/version={v}" for v in versions])
    return table.where(reduce(or_, [(F.col("version") == v) & F.col("bucket").isin(b) for v, b in versions.items()]))


def _publish(spark: SparkSession, target: str, version: Version) -> None:
    rows = [(version.epoch, b, v) for b, v in version.buckets.items()] or [(version.epoch, None, None)]
    note = spark.createDataFrame(rows, "epoch long, bucket int, bucket_version long")
    note.coalesce(1).write.mode("overwrite").parquet(f"{target}/{DONE}/version={version.number}")


def _write(rows: DataFrame, target: str, name: str, version: int) -> None:
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/{name}/version={version}")


USAGE_ROWS = T.StructType([STOCK_DAILY[c] for c in (*PAIR, "date", *SCORE_TIES)])


def _write_metrics(spark: SparkSession, target: str, version: int, scored: DataFrame, buckets: int, policy: Policy) -> T.StructType:
    """The metrics, and the at-risk table chained on what was written; their schema."""
    _write(scored.withColumn("bucket", _bucket(buckets)).repartition("bucket"), target, METRICS, version)
    written = spark.read.schema(T.StructType([*scored.schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{target}/{METRICS}/version={version}")
    _write(written.where(is_at_risk(F.col("days_of_cover"), policy.orange_days)), target, AT_RISK, version)
    return scored.schema


def stream_metrics(
    spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int | None = None,
    trigger: dict | None = None, policy: Policy = DEFAULT_POLICY, alert_clock: Callable[[], datetime] | None = None,
    buckets: int = BUCKETS, name: str | None = None,
) -> StreamingQuery:
    """Keep the metrics and at-risk tables below ``target`` up to date with appended stock rows.

    The newest 7 rows of every pair are kept in ``buckets`` parts by hash of the pair. An epoch merges its rows, cut to 7 a pair,
    with the parts of its pairs and writes these anew, in folders of its version; other parts are neither read nor written, so
    an epoch's work follows the pairs it touches. A late row counts if it belongs among the 7, as in batch. Readers see
    the tables of a version once it is noted as done, and an epoch that is noted is not applied again. ``buckets`` must stay the same
    for a target. With ``alert_clock`` every epoch adds alerts at that time, for all critical pairs of the current metrics that the
    alert table holds none of the last hour for.
    """
    slim = _files(spark, source, STOCK_DAILY, max_files).select(*USAGE_ROWS.names)
    order = newest_first("date", SCORE_TIES)

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        held = newest_version(spark, target) or Version(-1, -1, {})
        if epoch <= held.epoch:
            return
        version = held.number + 1
        rows = top_rows(batch, PAIR, order, policy.window_rows).select(*slim.columns, _bucket(buckets).alias("bucket")).persist()
        try:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]
            kept = _table(spark, target, USAGE, USAGE_ROWS, {b: held.buckets[b] for b in touched if b in held.buckets})
            merged = rows.unionByName(kept.drop("version")).repartition("bucket")
            _write(top_rows(merged, ["bucket", *PAIR], order, policy.window_rows).drop("rn"), target, USAGE, version)
        finally:
            rows.unpersist()
        now = Version(version, epoch, held.buckets | dict.fromkeys(touched, version))
        usage = _table(spark, target, USAGE, USAGE_ROWS, dict.fromkeys(touched, version)).drop("version", "bucket")
        schema = _write_metrics(spark, target, version, metrics(usage, policy), buckets, policy)
        if alert_clock:
            seen = _stored_alerts(spark, target).where(F.col("version") < version)
            current = _table(spark, target, METRICS, schema, now.buckets)
            dated = new_alerts(current, seen, alert_clock(), policy).withColumn("alert_date", F.to_date("alert_timestamp"))
            dated.write.mode("overwrite").partitionBy("alert_date").parquet(f"{target}/{ALERTS}/version={version}")
        _publish(spark, target, now)

    return _start(slim, sink, checkpoint, trigger, name)


def _current(spark: SparkSession, target: str, name: str) -> DataFrame:
    version = newest_version(spark, target)
    schema = metrics(spark.createDataFrame([], STOCK_DAILY)).schema
    return _table(spark, target, name, schema, version.buckets if version else {})


def current_metrics(spark: SparkSession, target: str) -> DataFrame:
    """The metrics of the newest version; a reader keeps the version it started with until that is vacuumed."""
    return _current(spark, target, METRICS).select(*METRIC_COLUMNS)


def current_at_risk(spark: SparkSession, target: str) -> DataFrame:
    return _current(spark, target, AT_RISK).select(*METRIC_COLUMNS)


def _stored_alerts(spark: SparkSession, target: str) -> DataFrame:
    schema = T.StructType([*CRITICAL_ALERTS, T.StructField("version", T.LongType()), T.StructField("alert_date", T.DateType())])
    try:
        return spark.read.schema(schema).parquet(f"{target}/{ALERTS}")
    except AnalysisException:  # no epoch has written alerts yet
        return spark.createDataFrame([], schema)


def critical_alerts(spark: SparkSession, target: str) -> DataFrame:
    """All alerts that ``stream_metrics`` added."""
    version = newest_version(spark, target)
    return _stored_alerts(spark, target).where(F.col("version") <= (version.number if version else -1)).select(*CRITICAL_ALERTS.names)


def refresh(
    spark: SparkSession, source: str, target: str, checkpoint: str, policy: Policy = DEFAULT_POLICY,
    alert_clock: Callable[[], datetime] | None = None, buckets: int = BUCKETS, log: RefreshLog | None = None, name: str | None = None,
) -> list[dict]:
    """Process everything new in the source, then return; the progress of the run. With ``log`` its table has the run on return."""
    with log or nullcontext():
        query = stream_metrics(spark, source, target, checkpoint, policy=policy, alert_clock=alert_clock, buckets=buckets, name=name)
        try:
            query.awaitTermination()
        finally:
            if log:
                log.wait(str(query.runId))
    return list(query.recentProgress)


def _source_files(spark: SparkSession, source: str) -> list[str]:
    return sorted(spark.read.schema(STOCK_DAILY).parquet(source).inputFiles())


def rebuild(
    spark: SparkSession, source: str, target: str, checkpoint: str, policy: Policy = DEFAULT_POLICY, buckets: int = BUCKETS, attempts: int = 10,
) -> Version:
    """A manual full refresh: overwrite the maintained tables by the batch metrics of all source rows.

    The stream first takes in what is new. The batch reads the files that were there before and after that, so the tables hold just
    what the stream has consumed and it goes on from here; while files keep arriving it is tried again. Readers see the old version
    or the new one. Alerts stay.
    """
    for _ in range(attempts):
        files = _source_files(spark, source)
        refresh(spark, source, target, checkpoint, policy, buckets=buckets)
        if files == _source_files(spark, source):
            break
    else:
        raise RuntimeError("files kept arriving during the refresh")
    held = newest_version(spark, target)
    if held is None:
        raise ValueError("the source has no rows yet")
    daily = spark.read.schema(STOCK_DAILY).parquet(*files)
    version = held.number + 1
    rows = top_rows(daily.select(*USAGE_ROWS.names), PAIR, newest_first("date", SCORE_TIES), policy.window_rows)
    _write(rows.select(*USAGE_ROWS.names, _bucket(buckets).alias("bucket")).repartition("bucket"), target, USAGE, version)
    _write_metrics(spark, target, version, metrics(daily, policy), buckets, policy)
    present = spark.read.schema("bucket int").parquet(f"{target}/{USAGE}/version={version}").distinct().collect()
    done = Version(version, held.epoch, {r[0]: version for r in present})
    _publish(spark, target, done)
    return done


def vacuum(spark: SparkSession, target: str) -> list[str]:
    """Remove the folders that the newest version does not need, alerts aside; their paths. Readers of older versions must be done."""
    held = newest_version(spark, target)
    if held is None:
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs
    removed = []
    for name in (USAGE, METRICS, AT_RISK, DONE):
        root = hadoop.Path(f"{target}/{name}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        needed = {held.number} if name == DONE else set(held.buckets.values())
        for status in files.listStatus(root):
            folder = status.getPath()
            kind, _, number = folder.getName().partition("=")
            if kind == "version" and int(number) < held.number and int(number) not in needed and files.delete(folder, True):
                removed.append(str(folder))
    return removed


def compact(spark: SparkSession, target: str, compacted: str) -> None:
    """Write the newest version to a fresh folder, with all that the stream needs to go on there."""
    held = newest_version(spark, target)
    if held is None:
        return
    schema = metrics(spark.createDataFrame([], STOCK_DAILY)).schema
    for name, kind in ((USAGE, USAGE_ROWS), (METRICS, schema), (AT_RISK, schema)):
        _write(_table(spark, target, name, kind, held.buckets).drop("version").repartition("bucket"), compacted, name, 0)
    _publish(spark, compacted, Version(0, held.epoch, dict.fromkeys(held.buckets, 0)))


def change_stream(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    """Row changes arriving as files."""
    return _files(spark, source, STOCK_CHANGES, max_files)


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _micros(column: str) -> Column:
    """A time without zone as microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"CAST(CAST(CAST({column} - {_EPOCH} AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)")


def _moment(column: str) -> Column:
    return F.expr(f"{_EPOCH} + make_dt_interval(0, 0, 0, CAST({column} AS DECIMAL(20, 0)) / 1000000)")


def _keyed(rows: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str = "none", keys: Sequence[str] = PAIR) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state is on disk, not on the heap
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", time_mode)


def _logging(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that adds what an epoch tells: new rows, and corrections of earlier ones. A repeated epoch overwrites its folder."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/log/epoch={epoch}")

    return sink


def _same(keys: list[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def _current_log(spark: SparkSession, target: str, columns: str) -> DataFrame:
    """The newest form of every row of a log; only corrected rows, which are few, are looked up."""
    schema = T.StructType([*T._parse_datatype_string(columns), T.StructField("epoch", T.LongType())])
    try:
        log = spark.read.schema(schema).parquet(f"{target}/log")
    except AnalysisException:  # before the first batch
        return spark.createDataFrame([], schema)
    key = ["id", *PAIR]
    newest = log.where("correction").groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max("epoch").alias("_epoch"))
    return log.join(newest, _same(key), "left").where("_epoch IS NULL OR epoch = _epoch")


def stream_change_log(
    spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int | None = None,
    trigger: dict | None = None, ttl: timedelta | None = None, run_rows: int = RUN, buckets: int = KEYS,
) -> StreamingQuery:
    """Log inserts and updates with the previous closing stock by time, whatever the order of arrival.

    The versions of a pair's rows are in keyed state, so an epoch reads its own rows and no earlier ones; a late row corrects the row
    after it. A key of the state is one of ``buckets`` parts by hash of the pair, which must stay the same for a checkpoint; with ``ttl``
    it is the pair. With ``ttl`` a pair's runs of versions that are all older, by their own time, than its newest one less ``ttl`` keep
    just their last version: later rows are right, and a late row among them is compared with that one. The default forgets nothing. Result: ``current_change_log``.
    """
    rows = change_stream(spark, source, max_files).where(F.col("change_type").isin("INSERT", "UPDATE")).select(
        *PAIR, F.coalesce(F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long"), F.lit(NEVER)).alias("day"),
        F.coalesce(_micros("change_timestamp"), F.lit(NEVER)).alias("at"), (F.col("change_type") == "UPDATE").cast("long").alias("kind"),
        F.col("closing_stock").isNotNull().cast("long").alias("has_stock"), F.coalesce("closing_stock", F.lit(0)).alias("stock"))
    if ttl is None:
        rows = rows.withColumn("bucket", _bucket(buckets)).mapInArrow(packed, "bucket int, blob binary")
    keys = ["bucket"] if ttl is None else PAIR
    return _start(_keyed(rows, ChangeLog(ttl, run_rows), CHANGE_OUT, keys=keys), _logging(target), checkpoint, trigger)


def current_change_log(spark: SparkSession, target: str) -> DataFrame:
    log = _current_log(spark, target, CHANGE_OUT)
    return log.select(
        F.when(F.col("at") != NEVER, _moment("at")).alias("change_timestamp"), *PAIR,
        F.when(F.col("day") != NEVER, F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))).alias("date"),
        F.when(F.col("kind") == 1, "UPDATE").otherwise("INSERT").alias("change_type"),
        F.when(F.col("has_old") == 1, F.col("old")).alias("old_closing_stock"), F.when(F.col("has_stock") == 1, F.col("stock")).alias("new_closing_stock"))


def stream_alerts(
    spark: SparkSession, source: str, target: str, checkpoint: str, max_files: int | None = None,
    trigger: dict | None = None, policy: Policy = DEFAULT_POLICY, watermark: str | None = None, run_rows: int = RUN,
) -> StreamingQuery:
    """One alert per pair and hour over a stream of critical observations, in the order of their time. Result: ``current_alerts``.

    By default nothing is dropped: observations are in keyed state, and a late one changes the alerts after it up to the first
    that stays. With ``watermark`` (such as "2 hours") state is bounded: observations wait until the watermark on their time has
    passed them, timers then decide them in order, and only the last alert of a pair is kept. Later ones than that are dropped, as are
    those without a time.
    """
    has = lambda c: F.col(c).isNotNull().cast("long")
    rows = _files(spark, source, ALERT_OBSERVATIONS, max_files).select(
        *PAIR, F.coalesce(_micros("alert_timestamp"), F.lit(NO_TIME)).alias("at"), has("action_id").alias("has_action"),
        F.coalesce("action_id", F.lit(0)).alias("action"), has("days_of_cover").alias("has_days"), F.coalesce("days_of_cover", F.lit(0.0)).alias("days"),
        has("suggested_reorder").alias("has_reorder"), F.coalesce("suggested_reorder", F.lit(0.0)).alias("reorder"))
    wait = timedelta(hours=policy.cooldown_hours)
    if watermark is None:
        told = _keyed(rows, Cooldown(wait, run_rows), ALERT_OUT)
    else:
        timed = rows.where(F.col("at") != NO_TIME).withColumn("event", F.timestamp_micros("at")).withWatermark("event", watermark)
        told = _keyed(timed, TimedCooldown(wait), ALERT_OUT, "eventTime")
    return _start(told, _logging(target), checkpoint, trigger)


def current_alerts(spark: SparkSession, target: str) -> DataFrame:
    alerts = _current_log(spark, target, ALERT_OUT).where("alert = 1")
    return alerts.select(
        F.when(F.col("has_action") == 1, F.col("action")).alias("action_id"), F.when(F.col("at") != NO_TIME, _moment("at")).alias("alert_timestamp"),
        *PAIR, F.when(F.col("has_days") == 1, F.col("days")).alias("days_of_cover"), F.when(F.col("has_reorder") == 1, F.col("reorder")).alias("suggested_reorder"))


_PROGRESS = "run_id string, batch_id long, started_at string, input_rows long, duration_ms long, state_rows long"


def refresh_history(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """One row per micro-batch of a finished or running query."""
    rows = [
        (str(p["runId"]), p["batchId"], p["timestamp"], p["numInputRows"],
         dict(p["durationMs"]).get("triggerExecution"), sum(s["numRowsTotal"] for s in p["stateOperators"]))
        for p in progress
    ]
    return spark.createDataFrame(rows, _PROGRESS)


def freshness(tables: dict[str, DataFrame], as_of: datetime | None = None) -> DataFrame:
    """Per table: rows, its newest data day and how many days that is behind ``as_of``."""
    today = F.to_date(clock(as_of))
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count"), F.max("date").alias("data_date")).select(
            F.lit(name).alias("table_name"), "row_count", "data_date",
            F.datediff(today, "data_date").cast("long").alias("days_behind"),
        )
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
