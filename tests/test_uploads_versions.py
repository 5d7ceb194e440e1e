"""Quarantine of bad lines, stored versions by day, SQL functions."""
from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stockhealth.functions.sql_functions import register_text_functions
from stockhealth.operators import changes as CH
from stockhealth.operators import metrics as M
from stockhealth.operators import narrative as N
from stockhealth.schema import STOCK_DAILY
from stockhealth.sources import contracts, tables

HEAD = "item,location,date,opening_stock,received,issued,closing_stock,lead_time_days,note"


def test_bad_lines_come_back(spark, fresh):
    lines = [
        "a,L,2026-01-01,1,2,3,0,,ok", "b,L,2026-01-01,1,2,n/a,0,4,", "c,L,someday,x,2,3,0,4,", "d,L,2026-01-01,1,2,3", "e,L,2026-01-01,1,2,3,0,4,ok,more",
        '"f, ""g""",L,2026-01-02,1,2,3,0,4,', "h,L,2026-01-01,1.5,2,3,0,4,",
    ]
    path, stock, bad = fresh("upload"), fresh("stock"), fresh("bad")
    spark.createDataFrame([(HEAD + "\n" + "\n".join(lines),)], "value string").coalesce(1).write.text(path)
    tables.load_upload(spark, path, stock, bad)
    good = tables.read_stock(spark, stock)
    assert good.schema == STOCK_DAILY and rows(good, "item", "date", "lead_time_days") == [("a", date(2026, 1, 1), None), ('f, "g"', date(2026, 1, 2), 4)]
    assert rows(spark.read.parquet(bad), "line", "reason") == sorted([
        (lines[1], "issued: n/a"), (lines[2], "date: someday, opening_stock: x"), (lines[3], "number of fields"), (lines[4], "number of fields"),
        (lines[6], "opening_stock: 1.5")], key=repr)
    tables.load_upload(spark, path, stock, bad)
    assert tables.read_stock(spark, stock).count() == 4 and spark.read.parquet(bad).count() == 10


def test_upload_without_a_column(spark, fresh):
    path = fresh("upload")
    spark.createDataFrame([("date,item\n2026-01-01,a",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(ValueError, match="location, opening_stock"):
        contracts.split_upload(spark, path)


def test_diff_of_versions_reads_changed_days(spark, seed, fresh):
    days = sorted(r[0] for r in seed.select("date").distinct().collect())
    old = seed.withColumn("date", F.when(F.col("date") != days[1], F.col("date")))
    new = old.withColumn("closing_stock", F.col("closing_stock") + F.when((F.col("date") == days[0]) & (F.col("location") == "East"), 1).otherwise(0))
    new = new.unionByName(new.where("date IS NULL").limit(1))
    a, b = fresh("old"), fresh("new")
    CH.save_version(old.repartition(3), a)
    CH.save_version(new, b)
    assert rows(CH.changed_days(spark, a, b)) == sorted([(days[0],), (None,)], key=repr)
    got = CH.diff_versions(spark, a, b)
    assert rows(got) == rows(CH.snapshot_diff(old, new)) and got.count() > 1
    assert CH.diff_versions(spark, a, a).count() == 0
    scan = CH._version_rows(spark, a).where(F.col("date").isin([days[0]]))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(scan.inputFiles()) >= 1


def test_text_functions(spark, seed):
    snapshot = M.metrics(seed).cache()
    register_text_functions(snapshot)
    asked = snapshot.select("location", "item").unionByName(spark.createDataFrame([("East", "none"), (None, "x")], "location string, item string"))
    asked.createOrReplaceTempView("asked")
    got = spark.sql("SELECT location, item, explain_reorder(location, item) AS explanation FROM asked WHERE location IS NOT NULL")
    assert rows(got) == rows(N.explain_reorder(snapshot, asked.where("location IS NOT NULL")))
    assert spark.sql("SELECT inventory_summary_prompt()").first()[0] == N.summary_prompt(snapshot).first().prompt
    assert N.NOT_FOUND in spark.sql("SELECT explain_reorder('East', 'none')").first()[0]
