"""The conversation trie against brute force, with few and many paths to a shard, copies, nulls and clashing columns."""
import random

import brute
import numpy as np
import pytest

from stockhealth.llm import prefixes as P
from stockhealth.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, _key string, n_convs long"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_double_array():
    rng = random.Random(1)
    for _ in range(40):
        words = [[rng.randint(0, rng.choice([2, 30, 500])) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 200))]
        trie, nodes = P.DoubleArray(4), {(): 0}
        for level in range(6):
            pairs = sorted({(nodes[tuple(w[:level])], w[level]) for w in words if len(w) > level})
            if pairs:
                a, b = (np.array(x) for x in zip(*pairs))
                trie.insert(a, b)
                for w in words:
                    if len(w) > level:
                        nodes[tuple(w[:level + 1])] = int(trie.step(np.array([nodes[tuple(w[:level])]]), np.array([w[level]]))[0])
        assert len(set(nodes.values())) == len(nodes) and -1 not in nodes.values()
        assert int((trie.check >= 0).sum()) == len(nodes)
        assert trie.step(np.array([0]), np.array([10_000]))[0] == -1


def conversations(seed, n=70):
    rng = random.Random(seed)
    said = [("user", "hi there"), ("assistant", "yes  no\tmaybe"), ("user", None), (None, "x"), ("", ""), ("user", "hi")]
    rows = []
    for c in rng.sample(range(200), n):
        turns = [rng.choice(said if rng.random() < 0.3 else said[:2]) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))]
        order = rng.sample(range(50), len(turns))
        rows += [(c, None if t == 0 and rng.random() < 0.5 else t, *s) for t, s in zip(sorted(order), turns)]
    return rows + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("paths", [1, 2, 5, P.PATHS])
def test_trie(spark, paths):
    rows = conversations(paths)
    table = spark.createDataFrame([(*r, "d", "k", 7) for r in rows], SCHEMA).repartition(3)
    assert got(P.trie(table, paths=paths)) == brute.op12(rows)


def test_small_tables(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert P.trie(table).count() == 0
    # 21 lends its first turns from 20, which is absent; some of these have no turn left, so the root may have no child.
    for rows in ([(21, 0, "user", "a")], [(c, 0, "user", "a") for c in range(21, 40)], [(40, 0, "user", "a b"), (41, 0, "user", "a b"), (41, 1, "user", "c")]):
        table = spark.createDataFrame([(*r, "d", "k", 7) for r in rows], SCHEMA)
        assert got(P.trie(table)) == brute.op12(rows)
    twice = spark.createDataFrame([(1, 0, "u", "a", "", "", 0)] * 2 + [(1, 0, "u", "b", "", "", 0)], SCHEMA)
    assert got(P.trie(twice)) == got(P.trie(twice.repartition(2)))


def test_query(spark):
    from helpers import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_trie"](spark, SF)) == brute.op12(rows)
