"""Whitening against numpy's eigenvalues, with copies, ties, unusable vectors and other lengths."""
import brute
import numpy as np
import pytest

from stockhealth.llm import whitening as W
from stockhealth.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n string, whitened string, _vector string"


def check(found, rows, tolerance=1e-9):
    want = brute.op11(rows)
    got = {(r.vec_id, r.component): r for r in found}
    assert got.keys() == want.keys() and len(found) == len(want)
    for key, (n, deviation, size, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - size) < tolerance and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9
    return got


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n, rank", [(1, 1), (2, 2), (9, 4), (40, 40), (33, 0)])
def test_factor(n, rank):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, rank)) * np.logspace(0, -3, rank)
    a = m @ m.T
    l = W.cholesky(a)
    assert l.shape == (n, rank) and np.abs(l @ l.T - a).max(initial=0) < 1e-12
    assert all((l[:, k] == 0).sum() >= k for k in range(rank))  # triangular in the order of the pivots
    e, u = W.components(a)
    assert np.abs(u.T @ u - np.eye(rank)).max(initial=0) < 1e-12 and np.abs((u * e) @ u.T - a).max(initial=0) < 1e-12
    assert list(e) == sorted(e, reverse=True)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(20, 20)) * np.linspace(1, 4, 20)
    rows = [(i, [float(c) for c in (rng.normal(size=20) @ spread).astype(np.float32)]) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [c + 1e-6 for c in rows[0][1]]), (203, [0.0] * 20)]
    odd = [(300, None), (301, []), (302, [None] * 20), (303, [float("nan")] * 20), (304, [float("inf")] * 20), (305, [3e38] * 20), (306, [1.0] * 7)]
    got = check(W.whiten(frame(spark, rows + odd)).collect(), rows)
    # Either sign, but one for all rows.
    assert got[200, 3].whitened == got[0, 3].whitened and {k for _, k in got} == set(range(1, 17))
    by_row = np.array([[got[i, k].whitened for k in range(1, 17)] for i in range(120)])
    assert np.abs(np.corrcoef(by_row.T) - np.eye(16)).max() < 0.2


def test_few_and_large(spark):
    rows = [(1, [0.5, 0.5, 0.0]), (2, [0.5, -0.5, 0.0]), (None, [0.25, 0.5, 1.0]), (2, [0.5, -0.5, 0.0])]
    found = W.whiten(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)] and found[0].n == 3
    assert W.whiten(frame(spark, rows[:1])).count() == 0 and W.whiten(frame(spark, rows).where("false")).count() == 0
    huge = [(1, [1e12, 1.0]), (2, [2e15, -1.0]), (3, [-1e16, 0.5])]
    got = {r.vec_id: r.deviation for r in W.whiten(frame(spark, huge)).where("component = 1").collect()}
    assert set(got.values()) == {None}
    wide = [(1, [1e6, 1.0]), (2, [3e7, -1.0]), (3, [-3e6, 0.5])]
    wide = [(i, [float(np.float32(c)) for c in v]) for i, v in wide]
    exact = {r.vec_id: r.deviation for r in W.whiten(frame(spark, wide)).where("component = 1").collect()}
    for (i, _), (_, deviation, *_) in brute.op11(wide).items():
        assert exact[i] == (deviation if deviation < 2**63 else None)
    assert None in exact.values() and len(set(exact.values())) > 1


def test_query(spark):
    from helpers import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op11_whitening"](spark, SF).collect(), rows, 1e-6)
