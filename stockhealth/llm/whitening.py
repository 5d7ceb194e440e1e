"""Embedding whitening: principal axes from a pivoted Cholesky factor, turned by one-sided Jacobi rotations.

The vectors become whole numbers first, so that copies, sums and deviations are exact. Every distinct vector is in the fit list
once. Sums come first; then every task adds up the products of its centred vectors, one matrix a task, and the matrices
are added row by row. What reaches the driver is one matrix of the vectors' length, whatever the number of vectors.
There, pivoted Cholesky of the centred scatter gives a triangular factor of falling diagonal, which one-sided Jacobi turns
directly, until its columns are at right angles: their squared norms are the eigenvalues, the normalised columns the components.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockhealth.llm.common import pin

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
_ROWS = 4096  # vectors in flight
_LONG = 2.0**63


def cholesky(a: np.ndarray) -> np.ndarray:
    """``l`` with ``a = l @ l.T`` for a symmetric matrix without negative eigenvalues; one column for each of its rank.

    The largest remaining diagonal entry is the next pivot; the rows of the factor stay in the order of ``a``, so in the order
    of the pivots it is lower triangular. It ends where what remains is rounding.
    """
    n = len(a)
    l, left = np.zeros((n, n)), np.diag(a).astype(float).copy()
    least = n * np.finfo(float).eps * left.max(initial=0)
    for k in range(n):
        p = int(np.argmax(left))
        if left[p] <= least:
            return l[:, :k]
        l[:, k] = (a[:, p] - l[:, :k] @ l[p, :k]) / np.sqrt(left[p])
        l[left == -np.inf, k] = 0  # rows of earlier pivots are done
        left = left - l[:, k] ** 2
        left[p] = -np.inf
    return l


def jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``l`` times a rotation, with columns at right angles to each other, longest first.

    A round turns disjoint pairs of columns, a sweep (rounds as in a tournament) each pair once; it ends when no pair turned.
    """
    u = l.T.copy()  # rows are columns of the factor
    n = len(u)
    if n < 2:
        return l
    seats = np.arange(n + n % 2)
    tiny = np.finfo(float).eps * np.sqrt(l.shape[0])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            x, y = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
            x, y = np.minimum(x, y), np.maximum(x, y)
            x, y = x[y < n], y[y < n]
            a, b, c = (u[x] ** 2).sum(1), (u[y] ** 2).sum(1), (u[x] * u[y]).sum(1)
            go = np.abs(c) > tiny * np.sqrt(a * b)
            if go.any():
                turned = True
                x, y, a, b, c = x[go], y[go], a[go], b[go], c[go]
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1, -1) / (np.abs(z) + np.hypot(1, z))
                cos = 1 / np.hypot(1, t)
                sin = cos * t
                u[x], u[y] = cos[:, None] * u[x] - sin[:, None] * u[y], sin[:, None] * u[x] + cos[:, None] * u[y]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    return u[np.argsort(-(u**2).sum(1), kind="stable")].T


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    u = jacobi(cholesky(covariance))
    e = (u**2).sum(0)
    u = u / np.sqrt(e)
    return e, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])


def usable(vector: str):
    """Whether a vector has only finite entries that fit a long after scaling; an empty one does not take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * SCALE + SHIFT >= F.lit(_LONG)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def _whole(vectors: pd.Series) -> np.ndarray:
    return np.floor(np.stack(vectors.to_list()).astype(float) * SCALE).astype(np.int64) + SHIFT


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal vectors of whole numbers are equal strings of bytes, four to a number where all of them fit."""
    for frame in batches:
        x = _whole(frame["_vector"])
        small = ((x >= -(1 << 31)) & (x < 1 << 31)).all(axis=1)
        yield pd.DataFrame({"_x": [row.astype("<i4").tobytes() if s else row.tobytes() for row, s in zip(x, small)], "_wide": ~small})


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for frame in batches:
        for wide, kind in ((False, "<i4"), (True, "<i8")):
            some = frame["_x"][frame["_wide"] == wide]
            for at in range(0, len(some), _ROWS):
                part = some.iloc[at:at + _ROWS]
                yield np.frombuffer(b"".join(part), kind).reshape(len(part), -1).astype(np.int64)


def _narrow(*values: int) -> bool:
    """Whether sums and products up to these sizes stay inside 64 bits."""
    return max(values) < 1 << 62


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact: whole numbers of any size (dtype object) where 64 bits might not do."""
    if _narrow(n * (int(np.abs(x).max(initial=0)) + 1), max(map(abs, sums.tolist()), default=0)):
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _squares(d: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null where it does not fit a long."""
    most = max((abs(int(v)) for v in (d.min(initial=0), d.max(initial=0))), default=0)
    if _narrow(most * most * max(d.shape[1], 1)):
        return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in d.tolist())]


def _added(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum of one ``size`` x ``size`` matrix a task, added row by row in the order of the tasks."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for x in _matrices(batches):
            v = make(x)
            total += v.T @ v
        yield pd.DataFrame({"row": np.arange(size), "task": TaskContext.get().partitionId(), "cells": [r.tobytes() for r in total]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, total = None, np.zeros(size)
        for frame in batches:
            for r, cells in zip(frame["row"].tolist(), frame["cells"]):
                if r != row and row is not None:
                    yield pd.DataFrame({"row": [row], "cells": [total.tobytes()]})
                    total = np.zeros(size)
                row, total = r, total + np.frombuffer(cells)
        if row is not None:
            yield pd.DataFrame({"row": [row], "cells": [total.tobytes()]})

    parts = rows.mapInPandas(partial, "row int, task int, cells binary").repartition("row").sortWithinPartitions("row", "task")
    out = np.zeros((size, size))
    for r, cells in parts.select("row", "cells").mapInPandas(add, "row int, cells binary").collect():
        out[r] = np.frombuffer(cells)
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = COMPONENTS) -> DataFrame:
    """One row per usable input row and component: id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, empty, holds null or non-finite entries, or entries too large for a long after scaling are dropped; so are vectors of
    another length than the most frequent one (of several, the longest). Entries become ``floor(64 * c) + 1000000``. There are as
    many components as the covariance has eigenvalues above rounding, ``top`` at most: none for fewer than two different vectors or an empty table.
    A ``deviation`` that does not fit a long is null. Rows that share an id, or have none, are whitened one by one.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector")).where(usable("_vector"))
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("_vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = first["length"]
    rows = rows.where(F.size("_vector") == size)
    fit = pin(rows.select("_vector").mapInPandas(_packed, "_x binary, _wide boolean").distinct(), "fit")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(size, object)
        for x in _matrices(batches):
            exact = x if _narrow(len(x) * (int(np.abs(x).max()) + 1)) else x.astype(object)
            n, total = n + len(x), total + exact.sum(axis=0).astype(object)
        yield pd.DataFrame({"at": np.arange(size + 1), "value": [str(v) for v in (*total.tolist(), n)]})

    sums = fit.mapInPandas(summed, "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()
    by_place = {r["at"]: int(r["v"]) for r in sums}
    n, sums = by_place[size], np.array([by_place[i] for i in range(size)], object)

    def centred(x: np.ndarray) -> np.ndarray:
        return (deviations(x, n, sums) / n).astype(float)

    covariance = _added(fit, centred, size) / n
    e, u = components(covariance)
    explained, e, u = e[:top] / np.trace(covariance) if len(e) else e, e[:top], u[:, :top]
    if not len(e):
        return vectors.sparkSession.createDataFrame([], schema)
    axes = u / np.sqrt(e)
    error = float(np.abs(_added(fit, lambda x: centred(x) @ axes, len(e)) / n - np.eye(len(e))).max())
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    k = len(e)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), _ROWS):
                part = frame.iloc[at:at + _ROWS]
                d = deviations(_whole(part["_vector"]), n, sums)
                out = pd.DataFrame({id_col: part["_id"].repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1), len(part))})
                out["n"] = n
                out["deviation"] = pd.array(_squares(d), "Int64").repeat(k)
                out["whitened"] = ((d / n).astype(float) @ axes).ravel()
                out["explained"] = np.tile(explained, len(part))
                out["identity_error"] = error
                yield out[names]

    return rows.mapInPandas(project, schema)
