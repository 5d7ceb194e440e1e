"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the keys are cut into fixed ranges, so a source that
holds most rows is many small groups; sums per range, their running totals and a sort inside each range give
the running word count before every document, and each source is cut at its exact budget.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockhealth.llm.common import WORD

RANGE_BITS = 12  # 4,096 key ranges a source


def source_targets(sizes: DataFrame, share: float = 1.5, weights: Sequence[int] = (5, 2, 1), cap: int = 2) -> DataFrame:
    """Targets for one row per source (``source``, ``source_size``): ``target`` in words.

    ``weights`` repeat over the sources in code-point order, null last. ``share`` of all words is dealt by weight; no
    target exceeds ``cap`` times its source, and what is above is dealt again among the rest. That water level
    has a closed form once the sources are sorted by the level at which they fill up. One row per source is
    ordered in one task.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    full = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    full = full.withColumn("fills_at", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    used = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    full = full.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - used) / left)
    level = F.max(F.when(F.col("fills_at") > F.col("level"), F.col("level"))).over(whole)
    full = full.withColumn("water", level)
    target = F.when(F.col("water").isNull() | (F.col("fills_at") <= F.col("water")), F.col("most").cast("double"))
    return full.select("source", "source_size", target.otherwise(F.col("water") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, weights: Sequence[int] = (5, 2, 1), cap: int = 2, keep: Sequence[str] = (),
) -> DataFrame:
    """The words each document gives to the mix: id, ``size``, ``source_size``, ``target``, ``taken``, and ``keep``
    (the id stands once).

    A source's budget is its target without the fraction. It takes ``budget / source_size`` whole epochs, and of
    the last one the documents in key order until the budget is reached; the document at the cut gives the words
    that are left, so the sum of ``taken`` is the budget. The key is the MD5 of the id, ties go by id and size:
    reruns agree, and rows alike in all three are interchangeable. Null text has size 0, a null id is a value like
    any other, null sources are one source, an empty table gives an empty result.
    """
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), key.alias("_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_s"),
        F.struct(*keep).alias("_keep") if keep else F.lit(None).cast("int").alias("_keep"),
    ).withColumn("_range", F.shiftright("_key", 60 - RANGE_BITS)).repartition("_s", "_range")
    sums = rows.groupBy("_s", "_range").agg(F.first("source").alias("source"), F.sum("size").alias("_sum"))
    totals = sums.groupBy("_s").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), share, weights, cap)
    targets = targets.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    budget = F.floor(F.col("target") + F.lit(1e-6))
    targets = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    earlier = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_s", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")).join(targets, "_s")
    inside = Window.partitionBy("_s", "_range").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_s", "_range"])
    room = F.col("_rest") - F.col("_offset") - F.col("_before")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), room))
    out = [F.col("_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken")]
    return placed.select(*out, *([F.col(f"_keep.{c}").alias(c) for c in keep if c != id_col]))


def copies(mixed: DataFrame, columns: Sequence[str], text_col: str = "text") -> DataFrame:
    """The mix as documents: one row per epoch a document is in, the one at the cut with its first words only.

    ``mixed`` comes from ``mix`` with ``keep`` holding ``columns``. Documents without words are in no mix.
    """
    # Each word with the white space before it: the first ones joined are the beginning of the text, unchanged.
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, F.col("_words").cast("int")), "")
    each = mixed.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    each = each.withColumn("_words", F.least(F.col("size"), F.col("taken") - F.col("_copy") * F.col("size")))
    return each.withColumn(text_col, F.when(F.col("_words") == F.col("size"), F.col(text_col)).otherwise(cut)).select(*columns)
