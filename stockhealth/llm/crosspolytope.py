"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

Three rounds of random signs and a fast Hadamard transform turn a unit vector pseudo-randomly; its hash is the signed axis
it is nearest to. A query probes, in every table, the axes it is nearest to itself; the rows stored there in any
table are its candidates, ranked by their inner product with the query on the original vectors. Hashes see
directions only, so vectors clearly longer than the mean, which win inner products, are candidates of every query.

The index is dealt into shards of up to ``SHARD`` rows, each with its own tables; all rows move once. The queries are a
stated set and visit every shard in blocks, and only the best ``k`` per query and shard go on. The hash functions
are the same everywhere, so the result does not depend on the number of shards.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockhealth.llm.common import pin
from stockhealth.llm.pstable import unit, usable

TABLES, PROBES = 6, 28
LONG = 1.05  # times the mean length: a candidate of every query
SHARD, SMALL_SHARD, SHARDS = 65_536, 1024, 24  # small inputs: up to SHARDS shards for parallelism
_QUERIES = 256


def rotated(vectors: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Unit vectors, padded to a power of two and turned by three rounds of signs and Hadamard transform."""
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), size))
    x[:, :vectors.shape[1]] = vectors
    signs = np.random.default_rng([seed, table, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        x = x * s
        half = 1
        while half < size:
            x = x.reshape(len(x), -1, 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), size)
            half *= 2
    return x


def axes(vectors: np.ndarray, table: int, seed: int, n: int) -> np.ndarray:
    """The ``n`` nearest signed axes of each vector, nearest first: i for axis i, size + i for its opposite."""
    x = rotated(unit(vectors), table, seed)
    both = np.concatenate([x, -x], axis=1)
    n = min(n, both.shape[1])
    if n == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :n]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, so equal vectors get equal scores."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out = out + a[:, i] * b[:, i]
    return out


def _shard_search(k: int, tables: int, probes: int, seed: int, long: float):
    """Search a partition sorted by (shard, asked): the rows of a shard come before its queries."""

    def answers(index: dict, ids: np.ndarray, asked: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, len(ids), _QUERIES):
            q, q_ids = asked[at:at + _QUERIES], ids[at:at + _QUERIES]
            found = np.repeat(index["long"][None, :], len(q), axis=0)
            for table, axis in enumerate(index["axes"]):
                probe = axes(q, table, seed, probes)
                wanted = np.zeros((len(q), 2 << (max(1, (q.shape[1] - 1).bit_length()))), bool)
                np.put_along_axis(wanted, probe, True, axis=1)
                found |= wanted[:, axis]
            found &= q_ids[:, None] != index["ids"][None, :]
            score = np.where(found, q @ index["vectors"].T, -np.inf)
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(q), -np.inf)
            room = np.where(np.isfinite(least), 1e-9 * np.maximum(1, np.abs(least)), 0)
            a, b = np.nonzero((score >= (least - room)[:, None]) & found)
            exact, number = inner(q[a], index["vectors"][b]), index["ids"][b]
            order = np.lexsort((number, -exact, a))
            a, exact, number = a[order], exact[order], number[order]
            starts = np.searchsorted(a, np.arange(len(q)))
            top = np.arange(len(a)) - starts[a] < k
            yield pd.DataFrame({"query_id": q_ids[a[top]], "vec_id": number[top], "score": exact[top]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored: dict[tuple, list[pd.DataFrame]] = {}
        index: dict = {}
        for frame in batches:
            for key, part in frame.groupby(["_shard", "_length"], sort=False):
                rows, ask = part[~part["_asked"]], part[part["_asked"]]
                if key not in stored:
                    stored, index = {key: []}, {}
                if len(rows):
                    stored[key].append(rows)
                if len(ask):
                    if not stored[key]:
                        continue
                    if not index:
                        every = pd.concat(stored[key])
                        vectors = np.stack(every["_vector"].to_list())
                        length = np.sqrt((vectors * vectors).sum(axis=1))
                        index = {"ids": every["_id"].to_numpy(np.int64), "vectors": vectors, "long": length > long,
                                 "axes": [axes(vectors, t, seed, 1)[:, 0] for t in range(tables)]}
                    yield from answers(index, ask["_id"].to_numpy(np.int64), np.stack(ask["_vector"].to_list()))

    return run


def search(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, seed: int = 5,
) -> DataFrame:
    """The ``k`` rows with the largest inner product found for each query row: ``query_id``, ``rank``, ``vec_id``, ``score``.

    A query's own id is not among its results; ties go to the smaller id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows with a null id; only vectors of one length are compared. A repeated
    row is a candidate each time; a repeated query id counts once, with its smallest vector. An empty table or no query
    gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"), queries.alias("_query"))
    rows = rows.where(usable("_vector") & F.col("_id").isNotNull()).withColumn("_length", F.size("_vector"))
    rows = pin(rows, "vectors")
    norm = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda s, x: s + x * x))
    n, mean = rows.agg(F.count(F.lit(1)), F.avg(norm)).first()
    shards = max(-(-n // SHARD), min(-(-n // SMALL_SHARD), SHARDS), 1)
    # Ids may repeat, so a hot id must not fill a shard: rows are dealt by id and vector, copies in turn.
    deal = F.pmod(F.xxhash64("_id", "_vector", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    stored = rows.select("_id", "_vector", "_length", deal.alias("_shard"), F.lit(False).alias("_asked"))
    asked = rows.where("_query").groupBy("_id").agg(F.min("_vector").alias("_vector")).withColumn("_length", F.size("_vector"))
    asked = asked.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_asked", F.lit(True))
    both = stored.unionByName(asked).repartition("_shard").sortWithinPartitions("_shard", "_length", "_asked")
    run = _shard_search(k, tables, probes, seed, LONG * (mean or 0.0))
    found = both.mapInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
