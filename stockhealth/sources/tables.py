"""Reading and writing the stock table, metrics and exports."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockhealth.operators.actions import log_actions
from stockhealth.operators.forecast import attach_forecast, forecast, metrics_forecast
from stockhealth.operators.metrics import metrics_rounded
from stockhealth.operators.reports import risk_order
from stockhealth.policy import DEFAULT_POLICY, Policy
from stockhealth.schema import ACTION_LOGS, NUMERIC_METRICS, STOCK_DAILY
from stockhealth.session import pin
from stockhealth.sources.contracts import split_upload
from stockhealth.sources.id_blocks import BLOCK, claim_blocks, id_at, next_block, open_claims


def read_stock_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stock CSV in the contract's types, whatever its column order; a bad value is an error."""
    return typed_stock(read_upload_csv(spark, path))


def read_upload_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stock CSV as text, for ``contracts.validate_upload``; columns are named by the header."""
    return spark.read.option("header", True).csv(path)


def typed_stock(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in STOCK_DAILY.fields])


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view, or a Parquet path, with lower-case column names."""
    return lower_columns(spark.read.parquet(name) if "/" in name else spark.table(name))


def coerce_numeric(df: DataFrame, columns: list[str] = NUMERIC_METRICS) -> DataFrame:
    """The given columns as DOUBLE; text that is no number becomes null. Absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("double") for c in present})


def resolve_metrics(
    spark: SparkSession,
    daily: DataFrame,
    table: str = "inventory_metrics_dt",
    view: str = "inventory_metrics_v",
    with_forecast: bool = True,
    policy: Policy = DEFAULT_POLICY,
) -> tuple[DataFrame, str]:
    """Metrics from the refreshed table, else the view, else computed; with the source that was used."""
    for name, source in ((table, "refreshed_table"), (view, "view")):
        if spark.catalog.tableExists(name):
            ready = coerce_numeric(read_table(spark, name))
            return (attach_forecast(ready, forecast(daily, policy)) if with_forecast else ready), source
    return (metrics_forecast(daily, policy) if with_forecast else metrics_rounded(daily, policy)), "computed"


def append_stock(rows: DataFrame, path: str) -> None:
    """Append a form row or a whole upload in one write; nothing is de-duplicated."""
    typed_stock(rows).write.mode("append").parquet(path)


def load_upload(spark: SparkSession, upload: str, path: str, quarantine: str, columns: list[str] | None = None) -> None:
    """Append an upload's good rows to the stock table and its bad lines, with reason and upload, to the quarantine table."""
    good, bad = split_upload(spark, upload, columns)
    bad.withColumn("upload", F.lit(upload)).write.mode("append").parquet(quarantine)
    append_stock(good, path)


def read_stock(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STOCK_DAILY).parquet(path)


def seed(spark: SparkSession, csv_path: str, path: str) -> None:
    """Replace the stock table by the rows of a seed file."""
    read_stock_csv(spark, csv_path).write.mode("overwrite").parquet(path)


def append_actions(actions: DataFrame, path: str) -> None:
    """Append completed actions; one folder per day keeps time filters cheap.

    Rebalancing gathers a day's rows into few files and still splits a day that holds most of them.
    """
    days = actions.withColumn("action_date", F.to_date("action_timestamp")).hint("rebalance", "action_date")
    days.write.mode("append").partitionBy("action_date").parquet(path)


def append_as_writer(
    new: DataFrame, path: str, order: list[Column] | None = None, user: str | None = None, as_of: datetime | Column | None = None, block: int = BLOCK,
) -> None:
    """Complete a batch of actions and append it to a log that others may be appending to.

    Ids follow ``order`` within blocks that no other writer gets, so they are unique, ascend within a batch and have gaps.
    Every batch has a folder of its own, named by its first block: writers that commit to one folder would clear each other's files.
    All writers of a log use this function and the same ``block``. A batch without rows leaves no trace.
    """
    spark = new.sparkSession
    new = pin(new, "actions")  # counted and numbered from the same rows
    rows = new.count()
    if not rows:
        return
    open_claims(spark, path)
    last = read_actions(spark, path).agg(F.max("action_id")).first()[0]
    blocks = claim_blocks(spark, path, next_block(last, block), -(-rows // block))
    done = log_actions(new, order=order, user=user, as_of=as_of, id_at=lambda n: id_at(n, blocks, block))
    append_actions(done, f"{path.rstrip('/')}/id_block={blocks[0]}")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """A log of several writers, with ``action_date`` for filters on days; what has no data yet is empty."""
    log = spark.read.schema(ACTION_LOGS).option("basePath", path).parquet(path)
    return log.drop("id_block")


def append_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with a header; parts follow the order of ``df``."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def export_priority(at_risk: DataFrame, path: str) -> None:
    export_csv(at_risk.orderBy(*risk_order()), path)


def export_po(orders: DataFrame, path: str) -> None:
    columns = ["priority", "item", "location", "suggested_reorder", "lead_time_days"]
    export_csv(orders.orderBy(*risk_order()).select(*columns), path)
