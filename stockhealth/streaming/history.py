"""Refresh history as a table: what every run of a streaming query did, kept when the driver is gone."""
from __future__ import annotations

import threading
import time
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from stockhealth.operators.actions import clock

HISTORY = ("query_name string, query_id string, run_id string, batch_id long, started_at timestamp_ntz, ended_at timestamp_ntz, "
           "input_rows long, state_rows long, state string, error string")
TARGET_SECONDS = 60  # how far a maintained table may lag


def _utc(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)


class RefreshLog(StreamingQueryListener):
    """Appends one row per epoch (SUCCEEDED) and one per end of a run (FINISHED or FAILED, with the error) to the table at ``path``.

    Rows are written when a run ends and at most every ``flush_seconds`` before that, so a long run makes few files. Use it as a
    context manager, or add it to ``spark.streams`` for all queries of a session.
    """

    def __init__(self, spark: SparkSession, path: str, flush_seconds: float = 60):
        self.spark, self.path, self.flush_seconds = spark, path, flush_seconds
        self.rows: list[tuple] = []
        self.started: dict[str, tuple] = {}
        self.ended: dict[str, threading.Event] = {}
        self.written = time.monotonic()

    def __enter__(self) -> RefreshLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Events come a little after the query; whether the end of the run was written in time."""
        return self.ended.setdefault(run_id, threading.Event()).wait(seconds)

    def onQueryStarted(self, event) -> None:
        self.started[str(event.runId)] = (event.name, str(event.id), _utc(event.timestamp))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        start = _utc(p.timestamp)
        end = start + timedelta(milliseconds=p.durationMs.get("triggerExecution", 0))
        self.rows.append((p.name, str(p.id), str(p.runId), p.batchId, start, end, p.numInputRows,
                          sum(s.numRowsTotal for s in p.stateOperators), "SUCCEEDED", None))
        if time.monotonic() - self.written > self.flush_seconds:
            self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        name, query, start = self.started.pop(run, (None, str(event.id), None))
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.rows.append((name, query, run, None, start, now, None, None, "FAILED" if event.exception else "FINISHED", event.exception))
        self._flush()
        self.ended.setdefault(run, threading.Event()).set()

    def _flush(self) -> None:
        rows, self.rows, self.written = self.rows, [], time.monotonic()
        self.spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("append").parquet(self.path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The table of a ``RefreshLog``; empty before its first run."""
    try:
        return spark.read.schema(HISTORY).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], HISTORY)


def refresh_status(history: DataFrame, as_of: datetime | None = None, target_seconds: int = TARGET_SECONDS) -> DataFrame:
    """Per query: its last state, error and end, and by how many seconds its tables lag at ``as_of``.

    A table is as fresh as the start of the last run that reached its end: what arrived before that is in it.
    """
    last = history.groupBy("query_name").agg(
        F.max_by(F.struct("state", "error"), F.struct("ended_at", F.col("state") != "SUCCEEDED")).alias("v"), F.max("ended_at").alias("last_end"),
        F.max(F.when(F.col("state") == "FINISHED", F.col("started_at"))).alias("fresh_at"),
        F.count_if(F.col("state") == "SUCCEEDED").alias("epochs"), F.count_if(F.col("state") == "FAILED").alias("failures"),
        F.coalesce(F.sum(F.when(F.col("state") == "SUCCEEDED", F.col("input_rows"))), F.lit(0)).alias("input_rows"))
    lag = F.expr("CAST(CAST(as_of - fresh_at AS INTERVAL SECOND) AS DECIMAL(20, 6))").cast("double")
    return last.withColumn("as_of", clock(as_of)).withColumn("lag_seconds", lag).select(
        "query_name", F.col("v.state").alias("state"), F.col("v.error").alias("error"), "epochs", "failures", "input_rows", "last_end", "fresh_at",
        "lag_seconds", F.coalesce(F.col("lag_seconds") <= target_seconds, F.lit(False)).alias("within_target"))
