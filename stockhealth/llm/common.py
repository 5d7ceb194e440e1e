"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockhealth.session import pin

__all__ = ["WORD", "cells", "components", "pin", "pin_last", "read_table", "slices", "small_batches"]

# Fixed value: a word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_EDGES = 250_000  # above, edges are joined by a merge: stored ones are packed, so their files say little about their size in memory


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a table; whatever else it holds is not read and cannot clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches in smaller parts, so that what a task makes of texts is sent on before the next part is made."""
    for frame in batches:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at:at + rows].reset_index(drop=True)
        del frame
        pa.default_memory_pool().release_unused()


def pin_last(df: DataFrame, name: str) -> DataFrame:
    """``pin``; the shuffle files that led to it go at once, not when the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return pin(df, name)
    finally:
        conf.set(key, before)


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Let the session send at most ``records`` rows to Python at once; texts may be long. A lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= records:
        spark.conf.set(key, str(records))


def cells(rows: DataFrame, keys: Sequence[str], block: int, spread: Column) -> DataFrame:
    """Cut groups into cells of about ``2 * block`` rows at most, so that any two rows of a group meet in one.

    Groups of one row are left out. A group of ``n > block`` rows is dealt by ``spread`` into ``m = ceil(n / block)``
    blocks, and each unordered pair of blocks is a cell (``_x``, ``_y``); ``_b`` is the row's own block.
    Group sizes come from a count that combines map-side; the join is a merge at every size, which AQE may split: Spark
    takes exploded rows to be as few as before, and would send them all to the driver for a broadcast.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").hint("merge")
    split = rows.join(sizes, list(keys)).withColumn("_m", F.ceil(F.col("_n") / block).cast("int"))
    split = split.withColumn("_b", F.pmod(spread, F.col("_m")).cast("int"))
    split = split.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return (
        split.withColumn("_x", F.least("_b", "_o")).withColumn("_y", F.greatest("_b", "_o"))
        .drop("_n", "_m", "_o")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, root) with the smallest id reachable.

    Alternates large-star and small-star steps until the edges no longer change. Every step is a grouped
    minimum (combined map-side) and a join, so a node with very many edges never meets in one task; each
    round is written to the shared folder, which cuts the lineage. Nodes without an edge to another node
    are not returned. Null ends and loops are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now, before = pin(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("v", "u") % (1 << 40)), F.lit(0))).first()
        sized = (lambda df: df.hint("merge")) if state[0] > _EDGES else (lambda df: df)
        if state == before or not state[0]:
            return sized(now.select(F.col("v").alias("node"), F.col("u").alias("root")))
        before = state
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(sized(least), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(sized(low), "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = pin(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "edges")
