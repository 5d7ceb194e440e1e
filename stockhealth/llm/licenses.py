"""License scans as an exact set-similarity join of text blocks with notice templates, DataFrame functions only.

A block is ``BLOCK`` words, a new one starts every half block, so a passage of up to half a block plus a word
lies inside one; a longer template has longer blocks, so that a passage of its length always does. A template matches a block that holds at least ``threshold`` of its distinct words. Words are
ordered by how many documents have them, over the whole corpus, rarest first; a block can only reach ``o`` of a
template's ``m`` words if it has one of the template's first ``m - o + 1`` (prefix), has at least ``o`` template
words at all (length), and enough words remain behind the place where the prefixes meet (position). What is
left is verified, so filters never change the result.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockhealth.llm.common import pin

# The pattern of a word, the phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Words of customary license notices, with the labels the join adds. Names that differ by a word are short, so that all of
# their words are needed.
NOTICES = (
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license", "mpl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
)
THRESHOLD = 0.8
BLOCK = 32


def _array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _needed(words: Sequence[str], threshold: float) -> int:
    return max(1, math.ceil(len(words) * threshold - 1e-9))


def _places(phrase: str) -> Column:
    """Word numbers at which the phrase starts; ``hits`` holds every word that any phrase has, in order."""
    words = phrase.split()

    def starts(i: Column) -> Column:
        at = F.get(F.col("hits"), i)
        test = at["w"] == words[0]
        for step, word in enumerate(words[1:], 1):
            later = F.get(F.col("hits"), i + step)
            test = test & (later["w"] == word) & (later["pos"] == at["pos"] + step)
        return F.coalesce(test, F.lit(False))

    index = F.filter(F.sequence(F.lit(0), F.size("hits")), starts)
    return F.transform(index, lambda i: F.get(F.col("hits"), i)["pos"])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES,
    threshold: float = THRESHOLD, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Base labels come from phrases whose words stand consecutively, counted at every place; ``labels`` adds those of
    matching templates, and ``score`` is the largest containment among these, 0 without one. Null text counts as
    empty: no words, no place (nulls), empty labels. Repeated rows and repeated or null ids give a row each; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    templates = [(sorted(set(text.split())), label) for text, label in notices]
    vocabulary = sorted({w for words, _ in templates for w in words} | {w for p, _ in phrases for w in p.split()})
    # One pass over the texts. A text stays only where the words it has at all could reach a phrase or a template.
    tokens = docs.select(
        F.col(id_col).alias("_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    ).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    tokens = tokens.select("_id", "_text", F.size("_words").cast("long").alias("n_words"), F.array_intersect("_words", _array(vocabulary)).alias("_has"))
    reach = [F.size(F.array_intersect("_has", _array(words))) >= _needed(words, threshold) for words, _ in templates]
    reach += [F.size(F.array_intersect("_has", _array(sorted(set(p.split()))))) == len(set(p.split())) for p, _ in phrases]
    possible = reach[0]
    for test in reach[1:]:
        possible = possible | test
    # The row number must not change between the two reads, so the pass is written out.
    kept = tokens.select("_id", "n_words", "_has", F.when(possible, F.col("_text")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    kept = pin(kept, "license_words")

    # Document frequencies of the template words only: bounded by the templates.
    counts = {r[0]: r[1] for r in kept.select(F.explode("_has").alias("w")).groupBy("w").count().collect()}
    place = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    halves = [max(block // 2, len(text.split()) - 1) for text, _ in notices]
    entries = []
    for number, (words, label) in enumerate(templates):
        ordered, needed = sorted(words, key=place.get), _needed(words, threshold)
        for i, w in enumerate(ordered[: len(ordered) - needed + 1]):
            entries.append(F.struct(
                F.lit(w).alias("w"), F.lit(halves[number]).alias("half"), F.lit(number).alias("template"), F.lit(i).alias("i"), F.lit(len(words)).alias("m"),
                F.lit(needed).alias("o"), F.lit(label).alias("label"), _array(ordered).alias("words")))
    index = spark.range(1).select(F.inline(F.array(*entries)))

    spread = kept.where("_text IS NOT NULL").repartition("_row").withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    hits = F.filter(
        F.transform("_words", lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda h: F.array_contains(_array(vocabulary), h["w"]))
    spread = spread.select("_row", hits.alias("hits"))
    for number, (phrase, _) in enumerate(phrases):
        spread = spread.withColumn(f"_p{number}", _places(phrase))
    base = [f"_p{n}" for n in range(len(phrases))]
    spread = pin(spread, "license_hits")
    every = F.flatten(F.array(*base))
    found = spread.select(
        "_row", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(base, phrases)]), lambda x: x.isNotNull()).alias("_base"))

    order = F.create_map(*[x for w, i in place.items() for x in (F.lit(w), F.lit(i))])
    at = [F.struct(F.lit(half).alias("half"), (F.floor(F.col("h.pos") / half) - back).alias("_block")) for half in sorted(set(halves)) for back in (0, 1)]
    blocks = spread.select("_row", F.explode("hits").alias("h")).select("_row", F.col("h.w").alias("w"), F.inline(F.array(*at)))
    blocks = blocks.groupBy("_row", "half", "_block").agg(F.collect_set("w").alias("_set"))  # at most the template words
    blocks = blocks.withColumn("_set", F.transform(F.array_sort(F.transform("_set", lambda w: F.struct(order[w].alias("at"), w.alias("w")))), lambda s: s["w"]))
    met = blocks.select("_row", "half", "_block", "_set", F.posexplode("_set").alias("j", "w")).join(index, ["w", "half"])
    met = met.where((F.size("_set") >= F.col("o")) & (1 + F.least(F.col("m") - F.col("i") - 1, F.size("_set") - F.col("j") - 1) >= F.col("o")))
    shared = F.size(F.array_intersect("_set", "words"))
    matched = met.where(shared >= F.col("o")).select("_row", "label", (shared / F.col("m")).alias("score"))
    matched = matched.groupBy("_row").agg(F.collect_set("label").alias("_more"), F.max("score").alias("score"))

    none = F.array().cast("array<string>")
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base_labels = F.coalesce(F.col("_base"), none)
    return kept.select("_row", "_id", "n_words").join(found, "_row", "left").join(matched, "_row", "left").select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        labels(base_labels).alias("base_labels"), labels(F.concat(base_labels, F.coalesce(F.col("_more"), none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
