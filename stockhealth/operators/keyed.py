"""Window helpers that stay parallel when one key holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockhealth.session import pin


def newest_first(column: str, ties: Sequence[str]) -> list[Column]:
    """Latest row first; ``ties`` make the order total over the values that are read."""
    return [F.col(column).desc_nulls_last()] + [F.col(c).desc_nulls_last() for c in ties]


def oldest_first(column: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(column).asc_nulls_first()] + [F.col(c).asc_nulls_first() for c in ties]


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key, numbered from 1.

    Spark limits each group before the exchange as well, so at most ``n`` rows per key and input
    partition move, whatever a key's share of the table.
    """
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(name) <= n)


def newest_rows(
    df: DataFrame, keys: Sequence[str], ties: Sequence[str], n: int, since: date | None = None
) -> DataFrame:
    """The newest ``n`` rows per key by date, numbered from 1.

    ``since`` is a hint for long histories. Keys with ``n`` rows from that day on need nothing older, so
    their older rows are dropped at the scan, before any sort or exchange. All other keys keep their
    whole history: the result does not depend on the hint. It is ignored when too many keys qualify
    for a broadcast.
    """
    order = newest_first("date", ties)
    if since is None:
        return top_rows(df, keys, order, n)
    recent = F.coalesce(F.col("date") >= F.lit(since), F.lit(False))
    served = df.where(F.col("date") >= F.lit(since)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    served = served.select(*[F.col(k).alias(f"_key_{k}") for k in keys])
    if served.limit(_MAX_SERVED_KEYS + 1).count() > _MAX_SERVED_KEYS:
        return top_rows(df, keys, order, n)
    older = df.where(~recent).join(F.broadcast(served), _same(keys), "left_anti")
    return top_rows(df.where(F.col("date") >= F.lit(since)).unionByName(older), keys, order, n)


_MAX_SERVED_KEYS = 2_000_000  # a few hundred MB as a broadcast
_ROW_BITS = (1 << 33) - 1  # the in-partition part of monotonically_increasing_id
_MAX_BROADCAST_KEYS = 100_000
_PIECES = 4  # an oversized group of hot_rows rows becomes this many pieces


def _pinned_order(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Range-sorted rows with their partition (``_part``) and place in it (``_row``).

    Written out, because every later pass must see the same partition bounds.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    return pin(placed, "ordered")


def with_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Number all rows 1..n by a total order without a single-task window.

    Rows are numbered inside their range partition and shifted by the sizes of the earlier ones.
    """
    ranged = _pinned_order(df, order)
    # One row per partition: small by construction.
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row") + 1)
        .drop("_part", "_row", "_offset")
    )


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])


def _oversized(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, int, int]:
    """Keys with more than ``hot_rows`` rows, how many there are and how many rows they hold."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    n_keys, n_rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    hot = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys])
    return (F.broadcast(hot) if n_keys <= _MAX_BROADCAST_KEYS else hot), n_keys, n_rows


def lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_back: int,
    value: str,
    apply: Callable[[DataFrame, list[str], list[Column]], DataFrame],
    hot_rows: int,
    coarse_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Run a window that reads ``value`` from at most ``rows_back`` preceding rows, any group size.

    ``apply(df, partition_columns, order_columns)`` adds the window columns. Groups of up to
    ``hot_rows`` rows take the plain window. Larger ones are range-split along the order (rows equal
    in every order column included), each piece is preceded by a halo of the ``rows_back`` rows
    before it, and the halo is removed afterwards: same result as one window over the whole group.
    Group sizes come from a count that combines map-side; when ``keys`` are nearly unique, give a
    subset with few values as ``coarse_keys`` and only its oversized groups are counted in full.
    """
    suspects = df
    if coarse_keys:
        coarse, n_coarse, _ = _oversized(df, coarse_keys, hot_rows)
        if n_coarse:
            suspects = df.join(coarse, _same(coarse_keys), "left_semi")
    else:
        n_coarse = 1
    hot, n_keys, n_rows = _oversized(suspects, keys, hot_rows) if n_coarse else (None, 0, 0)
    if not n_keys:
        return apply(df, list(keys), oldest_first(order[0], order[1:]))
    same_key = _same(keys)
    cold = apply(df.join(hot, same_key, "left_anti"), list(keys), oldest_first(order[0], order[1:]))

    in_order = [*[F.col(k).asc() for k in keys], *oldest_first(order[0], order[1:]), F.col("_id").asc()]
    pieces = _pinned_order(
        df.join(hot, same_key, "left_semi").withColumn("_id", F.monotonically_increasing_id()),
        in_order, partitions=_PIECES * n_rows // hot_rows + 1,
    ).drop("_id")
    piece = [*keys, "_part"]
    # At most rows_back rows per key and partition are left here.
    tails = top_rows(pieces.select(*piece, "_row", value), piece, [F.col("_row").desc()], rows_back)
    earlier = Window.partitionBy(*keys).orderBy("_part", "_row").rowsBetween(-rows_back, -1)
    at_start = Window.partitionBy(*piece).orderBy("_row")
    halo = (
        tails.withColumn("_before", F.collect_list(F.struct(F.col(value).alias(value))).over(earlier))
        .withColumn("_start", F.row_number().over(at_start))
        .where("_start = 1")
        .select(*piece, F.posexplode("_before").alias("_at", "_b"))
        .select(*piece, (F.col("_at") - rows_back).cast("long").alias("_row"), F.col(f"_b.{value}").alias(value),
                F.lit(True).alias("_halo"))
    )
    padded = pieces.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    split = apply(padded, piece, [F.col("_row").asc()]).where("NOT _halo").drop("_part", "_row", "_halo")
    return cold.unionByName(split)
