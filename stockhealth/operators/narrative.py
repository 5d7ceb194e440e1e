"""Plain-language texts built from the metrics."""
from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockhealth.functions import columns as C
from stockhealth.operators.keyed import with_position
from stockhealth.operators.reports import risk_order
from stockhealth.schema import PAIR

# Wording that must match word for word.
PROMPT_OPENING = (
    "Analyze this inventory situation and provide a concise, actionable summary for procurement teams:"
)
RED_HEADING = "Critical items (red status):"
ORANGE_HEADING = "Warning items (orange status):"
PROMPT_CLOSING = "Provide a brief, professional summary highlighting priorities and recommended actions."
EXPLAIN_OPENING = "Explain why this inventory item needs reordering in simple terms:"
EXPLAIN_CLOSING = "Provide a clear, actionable explanation for procurement teams."
NOT_FOUND = "Item not found in inventory metrics."
ALL_WELL_EMPTY = "✅ All items are well-stocked. No immediate action required."
ALL_WELL = "✅ All items are well-stocked."


def line_order() -> list[Column]:
    return [F.col("days_of_cover").asc_nulls_last(), F.col("location").asc_nulls_last(), F.col("item").asc_nulls_last()]


def _risk_line(status: str) -> Column:
    return F.concat(
        F.lit("- "), F.col("item"), F.lit(" at "), F.col("location"), F.lit(": Only " if status == "red" else ": "),
        C.decimal_text(F.col("days_of_cover")), F.lit(" days left, reorder "),
        C.decimal_text(F.col("suggested_reorder")), F.lit(" units"),
    )


def risk_lines(snapshot: DataFrame, status: str) -> DataFrame:
    """One bullet per pair of a status, numbered by days left; as many rows as there are pairs."""
    chosen = snapshot.where((F.col("status") == status) & F.col("days_of_cover").isNotNull())
    return with_position(chosen, line_order()).select(F.lit(status).alias("status"), "pos", _risk_line(status).alias("line"))


def summary_prompt(snapshot: DataFrame) -> DataFrame:
    """The whole prompt as one row, in one aggregate; ``summary_prompt_lines`` is the form for any catalogue size."""
    listed = snapshot.where(F.col("status").isin("red", "orange") & F.col("days_of_cover").isNotNull())
    line = F.when(F.col("status") == "red", _risk_line("red")).otherwise(_risk_line("orange"))
    lines = listed.select("status", "days_of_cover", *PAIR, line.alias("line"))

    def section(status: str) -> Column:
        return F.expr(
            "coalesce(listagg(line, '\\n') WITHIN GROUP (ORDER BY days_of_cover, location, item) "
            f"FILTER (WHERE status = '{status}'), 'None')"
        )

    return lines.agg(section("red").alias("red"), section("orange").alias("orange")).select(F.concat_ws(
        "\n\n",
        F.lit(PROMPT_OPENING),
        F.concat(F.lit(RED_HEADING + "\n"), F.col("red")),
        F.concat(F.lit(ORANGE_HEADING + "\n"), F.col("orange")),
        F.lit(PROMPT_CLOSING),
    ).alias("prompt"))


def summary_prompt_lines(snapshot: DataFrame) -> DataFrame:
    """The prompt in line form, for any catalogue size: ordered by (section, pos)."""
    heads = [(0, 0, PROMPT_OPENING), (1, 0, RED_HEADING), (2, 0, ORANGE_HEADING), (3, 0, PROMPT_CLOSING)]
    spark = snapshot.sparkSession
    texts = spark.createDataFrame(heads, "section int, pos long, line string")
    red, orange = risk_lines(snapshot, "red"), risk_lines(snapshot, "orange")
    for section, lines in ((1, red), (2, orange)):
        none = lines.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
            F.lit(section).alias("section"), F.lit(1).cast("long").alias("pos"), F.lit("None").alias("line"))
        texts = texts.unionByName(lines.select(F.lit(section).alias("section"), "pos", "line")).unionByName(none)
    return texts


def _explanation() -> Column:
    """The seven facts; a missing one makes the whole text the not-found sentence, as concatenation does."""
    facts = F.concat(
        F.lit("Current stock: "), F.col("closing_stock").cast("string"), F.lit(" units\nDays of cover remaining: "),
        C.decimal_text(F.col("days_of_cover")), F.lit(" days\nAverage daily consumption: "),
        C.decimal_text(F.col("avg_daily_issue"), 2), F.lit(" units/day\nLead time: "),
        F.col("lead_time_days").cast("string"), F.lit(" days\nSuggested reorder: "),
        C.decimal_text(F.col("suggested_reorder")), F.lit(" units\nPriority: "), F.col("priority"),
        F.lit("\nUrgency score: "), C.decimal_text(F.col("urgency_score")),
        F.lit(" (negative means critical)\n\n" + EXPLAIN_CLOSING),
    )
    return F.concat(
        F.lit(EXPLAIN_OPENING + "\n\nItem: "), F.col("item"), F.lit("\nLocation: "), F.col("location"), F.lit("\n"),
        F.coalesce(facts, F.lit(NOT_FOUND)),
    )


def explain_reorder(snapshot: DataFrame, requests: DataFrame) -> DataFrame:
    """Explanation per requested pair; one join for all requests."""
    return requests.select(*PAIR).join(snapshot, PAIR, "left").select(*PAIR, _explanation().alias("explanation"))


def explain_critical(snapshot: DataFrame) -> DataFrame:
    """Explanation for every red pair; the facts are on the row already, so there is no join."""
    return snapshot.where(F.col("status") == "red").select(
        *PAIR, "days_of_cover", "suggested_reorder", _explanation().alias("explanation")
    )


def _item_line(prefix: str) -> Column:
    return F.concat(
        F.lit("- **"), F.col("item"), F.lit("** at "), F.col("location"), F.lit(": " + prefix),
        C.printf_text(F.col("days_of_cover")), F.lit(" days remaining. Recommended reorder: **"),
        F.col("suggested_reorder").cast("bigint").cast("string"), F.lit(" units**"),
    )


def fallback_summary(at_risk: DataFrame, warnings_shown: int = 3) -> DataFrame:
    """Rule-based summary, one row: every red pair, the first three orange ones."""
    red, orange = F.col("status") == "red", F.col("status") == "orange"
    line = F.when(red, _item_line("Only ")).otherwise(_item_line(""))
    first_orange = (
        at_risk.where(orange).orderBy(*risk_order()).limit(warnings_shown)
        .select(_item_line("").alias("line"), C.priority_rank(F.col("priority")).alias("rank"), "days_of_cover", *PAIR)
    )
    in_order = "listagg(line, '\\n') WITHIN GROUP (ORDER BY rank, days_of_cover, location, item)"
    orange_text = first_orange.agg(F.expr(in_order)).scalar()
    counted = at_risk.select(
        "status", "days_of_cover", *PAIR, C.priority_rank(F.col("priority")).alias("rank"), line.alias("line")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(red).alias("n_red"), F.count_if(orange).alias("n_orange"),
        F.expr(f"{in_order} FILTER (WHERE status = 'red')").alias("red_text"),
    ).withColumn("orange_text", orange_text)
    parts = F.concat_ws(
        "\n",
        F.when(F.col("n_red") > 0, F.concat(
            F.lit("🚨 **"), F.col("n_red").cast("string"), F.lit(" critical item(s)** require immediate attention\n"),
            F.col("red_text"))),
        F.when(F.col("n_orange") > 0, F.concat(
            F.lit("\n⚠️ **"), F.col("n_orange").cast("string"), F.lit(" item(s)** need attention soon\n"),
            F.col("orange_text"))),
    )
    text = F.when(F.col("n") == 0, ALL_WELL_EMPTY).when(parts == "", ALL_WELL).otherwise(parts)
    return counted.select(text.alias("summary_text"))


def daily_summary(
    at_risk: DataFrame, day: date | Column | None = None, generated_at: datetime | Column | None = None,
) -> DataFrame:
    """The row to append to the summaries table for one day."""
    day = F.current_date() if day is None else day if isinstance(day, Column) else F.lit(day)
    at = F.current_timestamp() if generated_at is None else generated_at
    at = at if isinstance(at, Column) else F.lit(at)
    return fallback_summary(at_risk).select(
        day.cast("date").alias("summary_date"), "summary_text", at.cast("timestamp_ntz").alias("generated_at")
    )
