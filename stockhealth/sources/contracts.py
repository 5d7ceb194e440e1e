"""Data contracts: required columns, bad rows, enumerations, profiles and counts."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockhealth.schema import ACTION_STATUSES, ACTION_TYPES, METRIC_COLUMNS, PAIR, PRIORITIES, STOCK_DAILY
from stockhealth.session import pin


def missing_columns_of(present: list[str], required: list[str] | None = None) -> list[str]:
    return [c for c in required or STOCK_DAILY.fieldNames() if c not in set(present)]


def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    """Required upload columns that are absent, in contract order."""
    return missing_columns_of(df.columns, required)


def validate_upload(df: DataFrame) -> DataFrame:
    """One row: missing columns, all rows, rows with a value that does not fit its type."""
    missing = missing_columns(df)
    misfit = [
        F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        for f in STOCK_DAILY.fields if f.name not in missing
    ]
    bad = F.count_if(reduce(or_, misfit)) if misfit else F.lit(0).cast("long")
    return df.agg(
        F.lit(", ".join(missing)).alias("missing_columns"), F.count(F.lit(1)).alias("row_count"), bad.alias("bad_rows")
    )


def split_upload(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """An uploaded CSV as its good rows, in the contract's types, and its bad lines with the reason.

    Bad is a line with too few or too many fields, or with a value that does not fit its type; every such line comes back as it
    was sent. A quote inside a quoted field is doubled. ``columns`` names the fields of files without a header. A required column that is absent is an error.
    """
    names = columns or spark.read.option("header", True).csv(path).columns
    missing = missing_columns_of(names)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    typed = T.StructType([STOCK_DAILY[c] if c in STOCK_DAILY.names else T.StructField(c, T.StringType()) for c in names])
    reader = spark.read.schema(typed.add("_corrupt_record", T.StringType())).option("header", columns is None)
    # All fields are parsed whatever is selected, or a bad value in a field that is not read would go unseen.
    rows = pin(reader.option("mode", "PERMISSIVE").option("columnPruning", False).option("escape", '"').csv(path), "upload")  # parsed once for both halves
    good = rows.where("_corrupt_record IS NULL").select(*STOCK_DAILY.names)
    again = F.from_csv("line", F.lit(text.add("_ragged", T.StringType()).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")),
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ragged", "escape": '"'})
    bad = rows.where("_corrupt_record IS NOT NULL").select(F.col("_corrupt_record").alias("line")).withColumn("f", again)
    misfits = [F.when(F.col(f"f.{c}").isNotNull() & F.col(f"f.{c}").try_cast(STOCK_DAILY[c].dataType).isNull(), F.concat(F.lit(f"{c}: "), F.col(f"f.{c}")))
               for c in names if c in STOCK_DAILY.names]
    reason = F.when(F.col("f._ragged").isNotNull(), F.lit("number of fields")).otherwise(F.concat_ws(", ", *misfits))
    return good, bad.select("line", F.when(reason == "", "value").otherwise(reason).alias("reason"))


def check_contract(df: DataFrame, required: list[str] = METRIC_COLUMNS) -> DataFrame:
    """Per required column: is it there (any letter case), and in how many rows it has a value.

    One pass over the table, then one row per column.
    """
    by_name = {c.lower(): c for c in df.columns}
    found = [c for c in required if c.lower() in by_name]
    counts = df.agg(*[F.count(F.col(by_name[c.lower()])).alias(c.lower()) for c in found], F.count(F.lit(1)).alias("_rows"))
    facts = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(c in found).alias("present"),
            (F.col(c.lower()) if c in found else F.lit(0)).cast("long").alias("rows_with_value"),
        )
        for c in required
    ]
    return counts.select(F.inline(F.array(*facts)))


def profile(daily: DataFrame) -> DataFrame:
    """One row; reduced to pairs first, so the distinct counts run over pairs and not over days."""
    pairs = daily.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.min("first").alias("min_date"),
        F.max("last").alias("max_date"), F.count_distinct("location").alias("locations"),
        F.count_distinct("item").alias("items"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def footer_profile(spark: SparkSession, paths: dict[str, str], date_column: str = "date") -> DataFrame:
    """Rows and date range of stored Parquet tables from the statistics in their footers; no column is read.

    A table without ``date_column``, or whose date is a partition folder, has its rows counted only. Spark answers an aggregate by
    footers in its newer file reader, which a session of its own turns on here; the other sessions keep their settings.
    """
    fast = spark.newSession()
    fast.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    others = [s for s in fast.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    fast.conf.set("spark.sql.sources.useV1SourceList", ",".join(others))
    fast.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))

    def facts(name: str, path: str) -> DataFrame:
        table = fast.read.parquet(path)
        dated = date_column in table.columns and f"/{date_column}=" not in "".join(table.inputFiles()[:1])
        ends = [(f(date_column) if dated else F.lit(None).cast("date")).alias(c) for f, c in ((F.min, "min_date"), (F.max, "max_date"))]
        return table.agg(F.count(F.lit(1)).alias("row_count"), *ends).select(F.lit(name).alias("table_name"), "row_count", "min_date", "max_date")

    return reduce(DataFrame.unionByName, [facts(n, p) for n, p in paths.items()])


def check_enums(actions: DataFrame) -> DataFrame:
    """Values outside their enumeration, with how often they occur.

    The log is first reduced to its few value combinations.
    """
    allowed = {"action_type": ACTION_TYPES, "status": ACTION_STATUSES, "priority": PRIORITIES}
    combinations = actions.groupBy(*allowed).agg(F.count(F.lit(1)).alias("n"))
    values = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.when(~F.col(c).isin(v), F.col(c)).alias("bad_value"))
        for c, v in allowed.items()
    ]))
    found = combinations.select("n", values).where("bad_value IS NOT NULL")
    return found.groupBy("column_name", "bad_value").agg(F.sum("n").alias("n"))
