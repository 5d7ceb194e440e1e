"""The two text functions as functions of the session's catalog, for use in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame

from stockhealth.operators import narrative as N
from stockhealth.schema import PAIR

PROMPT, EXPLAIN = "inventory_summary_prompt", "explain_reorder"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def register_text_functions(snapshot: DataFrame) -> None:
    """Register ``inventory_summary_prompt()`` and ``explain_reorder(location, item)`` over a stored snapshot, with SQL bodies.

    They give the texts of ``narrative.summary_prompt`` and ``narrative.explain_reorder``. Called on a column, the second one is
    one join for all rows: its subquery is decorrelated. They last as long as the session, as do the views they read.
    """
    spark = snapshot.sparkSession
    N.summary_prompt(snapshot).createOrReplaceTempView(f"{PROMPT}_v")
    N.explain_reorder(snapshot, snapshot.select(*PAIR)).createOrReplaceTempView(f"{EXPLAIN}_v")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PROMPT}() RETURNS STRING RETURN (SELECT MAX(prompt) FROM {PROMPT}_v)")
    head = f"concat({_literal(N.EXPLAIN_OPENING + chr(10) * 2 + 'Item: ')}, wanted_item, {_literal(chr(10) + 'Location: ')}, wanted_location, {_literal(chr(10) + N.NOT_FOUND)})"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {EXPLAIN}(wanted_location STRING, wanted_item STRING) RETURNS STRING
        RETURN coalesce((SELECT MAX(e.explanation) FROM {EXPLAIN}_v e WHERE e.location = wanted_location AND e.item = wanted_item), {head})""")
