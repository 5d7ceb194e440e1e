"""Stock ledger and action log derived from the sales tables.

The ledger text runs unchanged on Spark and DuckDB; ``{name}`` marks an input table. Grouping by
(date, location, item) comes before the running sums, so a window holds at most one row per
calendar day however skewed the line items are.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SQL = """
WITH flow AS (
  SELECT CAST(l.l_shipdate AS DATE) AS date, s.s_name AS location, p.p_type AS item,
         MAX(s.s_suppkey) AS suppkey,
         CAST(SUM(CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity ELSE 0 END) AS BIGINT) AS received,
         CAST(SUM(CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity ELSE 0 END) AS BIGINT) AS demand
  FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  GROUP BY 1, 2, 3),
walk AS (
  SELECT *, CAST(SUM(received - demand) OVER (PARTITION BY location, item ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS x FROM flow),
refl AS (
  SELECT *, x - LEAST(0, MIN(x) OVER (PARTITION BY location, item ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS closing_stock FROM walk),
led AS (
  SELECT *, COALESCE(LAG(closing_stock) OVER (PARTITION BY location, item ORDER BY date), 0) AS opening_stock FROM refl)
SELECT date, location, item, opening_stock, received,
       opening_stock + received - closing_stock AS issued, closing_stock,
       CASE WHEN suppkey % 12 = 11 THEN NULL ELSE CAST(1 + (suppkey + LENGTH(item)) % 9 AS BIGINT) END AS lead_time_days
FROM led
"""

ACTIONS_SQL = """
WITH kinds AS (
  SELECT p_type AS item, ROW_NUMBER() OVER (ORDER BY p_type) - 1 AS ix
  FROM (SELECT DISTINCT p_type FROM {part})),
e AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         variant_get(parse_json(props), '$.k', 'int') AS k,
         user_id % (SELECT COUNT(*) FROM {supplier}) AS suppkey, (SELECT COUNT(*) FROM kinds) AS n_kinds
  FROM {events})
SELECT e.event_id + 1 AS action_id, CAST(e.ts AS TIMESTAMP_NTZ) AS action_timestamp,
  concat('user_', CAST(e.user_id AS STRING)) AS user_id,
  CASE e.event_type WHEN 'view' THEN 'VIEW_DETAILS' WHEN 'click' THEN 'ACKNOWLEDGE_ALERT'
    WHEN 'purchase' THEN 'CREATE_PO' WHEN 'signup' THEN 'EXPORT_CSV' ELSE 'DISMISS_ALERT' END AS action_type,
  CASE WHEN k % 20 = 19 THEN NULL ELSE s.s_name END AS location, kinds.item AS item, e.props AS action_details,
  CASE k % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Unknown' END AS priority,
  e.value AS days_of_cover, CAST(k AS DOUBLE) AS suggested_reorder,
  CASE k % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'COMPLETED' ELSE 'CANCELLED' END AS status
FROM e JOIN {supplier} s ON s.s_suppkey = e.suppkey JOIN kinds ON kinds.ix = k % e.n_kinds
"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def stock_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEDGER_SQL, **_tables(spark, sf_dir, "lineitem", "part", "supplier"))


def action_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACTIONS_SQL, **_tables(spark, sf_dir, "events", "part", "supplier"))


def suppkey_of(location: Column) -> Column:
    """The number in a supplier name."""
    return F.substring(location, 10, 20).cast("long")


def latest_timestamp(actions: DataFrame) -> Column:
    """The data's own clock as a scalar subquery."""
    return actions.agg(F.max("action_timestamp")).scalar()


def alert_observations(actions: DataFrame) -> DataFrame:
    """Critical actions; those of suppliers 3 mod 7 have lost their location."""
    known = F.when(suppkey_of(F.col("location")) % 7 != 3, F.col("location")).alias("location")
    return actions.where("priority = 'Critical'").select(
        "action_id", F.col("action_timestamp").alias("alert_timestamp"), known, "item",
        "days_of_cover", "suggested_reorder",
    )


def existing_alerts(actions: DataFrame) -> DataFrame:
    return actions.where("action_type = 'ACKNOWLEDGE_ALERT'").select(
        F.col("action_timestamp").alias("alert_timestamp"), "location", "item"
    )


def snapshot_pair(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two versions of the ledger: suppliers 0 mod 10 are new, 1 mod 10 are gone.

    The next four kinds changed in stock alone, in usage alone, in lead time alone, and to a missing usage.
    """
    digit = suppkey_of(F.col("location")) % 10
    old = daily.where(digit != 0)
    new = daily.where(digit != 1).withColumns({
        "closing_stock": F.col("closing_stock") + F.when(digit == 2, 1).otherwise(0),
        "issued": F.when(digit != 5, F.col("issued") + F.when(digit == 3, 1).otherwise(0)),
        "lead_time_days": F.col("lead_time_days") + F.when(digit == 4, 1).otherwise(0),
    })
    return old, new


def change_feed(daily: DataFrame) -> DataFrame:
    """One to three versions of each ledger row, an hour apart; some third versions are deletions."""
    suppkey = suppkey_of(F.col("location"))
    versions = daily.withColumn("version", F.explode(F.sequence(F.lit(1), (1 + suppkey % 3).cast("int"))))
    return versions.select(
        (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("version"))).alias("change_timestamp"),
        "location", "item", "date",
        F.when((F.col("version") == 3) & (suppkey % 9 == 8), "DELETE")
        .when(F.col("version") == 1, "INSERT").otherwise("UPDATE").alias("change_type"),
        (F.col("closing_stock") + F.col("version")).alias("closing_stock"),
    )
