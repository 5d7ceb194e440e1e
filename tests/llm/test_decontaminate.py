"""Decontamination against brute force: shared windows, short items, pieces, blocks of items, nulls and clashing columns."""
import random

import brute
import numpy as np
import pytest

from stockhealth.llm import decontaminate as D
from stockhealth.llm.oracle import ORACLES
from stockhealth.llm.queries import QUERIES


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        top, n, depth = rng.choice([1, 2, 3, 40, 5000]), rng.randint(0, 60), rng.randint(1, 12)
        text = np.array([rng.randint(0, top) for _ in range(n)], np.int32)

        def key(i):
            rest = text[i:i + depth].tolist()
            return rest[:rest.index(0)] if 0 in rest else rest

        order = D.suffix_array(text, top, depth).tolist()
        assert [key(i) for i in order] == sorted(map(key, order)) and sorted(order) == np.flatnonzero(text).tolist()


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["an", "Ber", "cos", "de", "É9", "fu"]) for _ in range(n))
    items = [(i, prose(rng.randint(3, 40))) for i in range(12)]
    items += [(20, items[0][1] + " zz"), (21, items[0][1]), (21, "Zebra crossing"), (22, None), (23, " .,"), (None, prose(15)), (2, items[3][1])]
    docs = [(i, " ".join(rng.choice([prose(rng.randint(1, 30)), *(t for _, t in items[:14])]) for _ in range(rng.randint(1, 4)))) for i in range(25)]
    docs += [(30, None), (31, ""), (32, "a, ZEBRA; crossing."), (32, "zebra crossings"), (None, items[0][1]), (33, docs[2][1]), (34, prose(900) + items[4][1])]
    return docs, items


def frames(spark, tables):
    docs = spark.createDataFrame([(*d, 1, "x") for d in tables[0]], "doc_id long, text string, n_words long, _text string").repartition(3)
    return docs, spark.createDataFrame([(*i, "y") for i in tables[1]], "item_id long, text string, doc_id string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words(monkeypatch):
    monkeypatch.setattr(D, "_CUT", 7)
    text = "Ab,cd É9é__x" * 5
    assert [w.decode() for part in D.words(text) for w in part] == brute.plain_words(text)


@pytest.mark.parametrize("shard, block", [(D.SHARD, D.BLOCK), (50, 700)])
def test_report(spark, tables, monkeypatch, shard, block):
    monkeypatch.setattr(D, "BLOCK", block)
    docs, items = frames(spark, tables)
    assert got(D.report(docs, items, shard=shard)) == brute.op13(*tables)
    left = D.remove(docs, items, shard=shard)
    bad = {r[0] for r in brute.op13(*tables) if r[-1]}
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in tables[0] if d not in bad)


@pytest.mark.parametrize("shard", [D.SHARD, 50])
def test_longest_matches(spark, tables, shard):
    docs, items = frames(spark, tables)
    named = [i for i in tables[1] if i[0] not in (None, 2, 21)]
    known = [d for d in tables[0] if d[0] not in (None, 32)]
    found = D.longest_matches(docs.where("doc_id <> 32"), items.where("item_id NOT IN (2, 21)"), 6, shard=shard)
    assert {(r.item_id, r.item_word): (r.n_words, r.n_places, (r.doc_id, r.doc_word)) for r in found.collect()} == brute.longest(known, named, 6)


def test_empty(spark, tables):
    docs, items = frames(spark, tables)
    assert D.report(docs.where("false"), items).count() == 0 and D.longest_matches(docs, items.where("false")).count() == 0
    assert {r.n_hit for r in D.report(docs, items.where("false")).collect()} == {0}
    assert D.remove(docs, items.where("false")).count() == docs.count()


def test_query(spark):
    from helpers import SF
    from oracle_check import connect, differences

    assert differences(QUERIES["op13_decontaminate"](spark, SF), connect(SF), ORACLES["op13_decontaminate"]) == []
