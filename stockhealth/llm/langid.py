"""Language identification: averaged hashed subword embeddings with a linear softmax.

Texts are folded to lower-case letters with one mark between words. Their character n-grams are hashed to buckets,
each bucket has an embedding, the mean of a text's embeddings goes through a linear softmax. Embeddings and
weights are trained by stochastic gradient descent in numpy on a bounded sample; since the model is linear after the
mean, prediction uses one score per bucket and language. Part of the sample is held back to calibrate the
softmax by a temperature and to set the levels below which a prediction is rejected.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockhealth.llm.common import slices, small_batches

BITS = 16
NGRAMS = (1, 2, 3, 4)
DIM = 16
SAMPLE = 600  # labelled rows per language that training reads at most
_CHUNK = 1 << 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 of everything else."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def folded(text: str) -> np.ndarray:
    """Code points of the text's letters in lower case, with a 0 between words and at both ends."""
    x = _fold_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    x = np.concatenate(([0], x, [0])).astype(np.uint32)
    return x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, a piece of the text at a time."""
    x = folded(text or "")
    if len(x) < 2:
        return
    for at in range(0, len(x), _CHUNK):
        part = x[at:at + _CHUNK + max(NGRAMS) - 1]
        own = min(_CHUNK, len(x) - at)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            h = h[:len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:]
            if n in NGRAMS:
                grams = h[:own]
                grams = (grams ^ grams >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)
                if n == 1:
                    grams = grams[part[:len(grams)] != 0]
                yield (grams ^ grams >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often it has them: at most 2 ** BITS entries."""
    found = np.zeros(1 << BITS, np.int64)
    for part in buckets(text):
        found += np.bincount(part, minlength=1 << BITS)
    at = np.flatnonzero(found)
    return at, found[at]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language, their mean gives logits; last column: 1 where training had the bucket
    bias: np.ndarray
    temperature: float
    least_score: float  # below: rejected
    least_seen: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability and whether the prediction is rejected; a text without a letter has none."""
        total, n = np.zeros(self.scores.shape[1]), 0
        for part in buckets(text):
            n += len(part)
            total += np.ones(len(part), np.float32) @ self.scores.take(part, axis=0)
        if not n or not self.languages:
            return UNKNOWN, 0.0, True
        p = softmax((total[:-1] / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least_score or total[-1] / n < self.least_seen)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 2.0, seed: int = 7) -> Model:
    """Train on (language, buckets, counts); every fifth row is held back for calibration."""
    languages = sorted({s[0] for s in sample})
    place = {x: i for i, x in enumerate(languages)}
    k, size = len(languages), 1 << BITS
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM))
    weight, bias = rng.normal(0, 0.1, (k, DIM)), np.zeros(k)
    rows = [(place[y], at, c / c.sum()) for y, at, c in sample if len(at)]
    if not rows:
        return Model([], np.zeros((size, 1), np.float32), np.zeros(0), 1.0, 0.0, 0.0)
    held, train = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    seen = np.zeros(size, np.float32)
    for _, at, _ in train:
        seen[at] = 1
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(train)):
            y, at, share = train[i]
            mean = share @ embedding[at]
            g = softmax(weight @ mean + bias)
            g[y] -= 1
            back = weight.T @ g
            weight -= step * np.outer(g, mean)
            bias -= 0.1 * step * g
            embedding[at] -= step * (share / share.max())[:, None] * back
    scores = np.column_stack([embedding @ weight.T, seen]).astype(np.float32)
    logits = np.array([share @ scores[at, :k] + bias for _, at, share in held]).reshape(-1, k)
    right = np.array([y for y, _, _ in held], int)
    temperature, least_score, least_seen = 1.0, 0.0, 0.0
    if len(held):
        picks = np.geomspace(0.02, 50, 120)
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean() for t in picks]
        temperature = float(picks[int(np.argmin(loss))])
        p = softmax(logits / temperature)
        sure = p.max(axis=1)[p.argmax(axis=1) == right]
        least_score = min(0.4, 0.8 * float(sure.min())) if len(sure) else 0.0
        least_seen = 0.8 * min(float(seen[at] @ share) for _, at, share in held)
    return Model(languages, scores, bias, temperature, least_score, least_seen)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows per language, those with the smallest hash of their id.

    Only rows with id and language count. The n-gram counts of whole texts are made in tasks; what comes to the driver is
    bounded by ``sample``, the number of languages and the number of buckets. Without labelled rows the model knows no
    language and rejects everything.
    """
    spark = docs.sparkSession
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ids = docs.select(docs[id_col].alias("_id"), docs[lang_col].alias("_lang")).where("_id IS NOT NULL AND _lang IS NOT NULL")
    ids = ids.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("_id").distinct()
    texts = docs.select(docs[id_col].alias("_id"), docs[lang_col].alias("_lang"), docs[text_col].alias("_text"))
    texts = texts.where("_lang IS NOT NULL").join(F.broadcast(ids), "_id")  # at most ``sample`` ids a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [counts(t) for t in frame["_text"]]
            yield pd.DataFrame({
                "_id": frame["_id"], "lang": frame["_lang"],
                "at": [a.astype("int32") for a, _ in found], "n": [np.minimum(c, 2**31 - 1).astype("int32") for _, c in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInPandas(run, f"_id {kind}, lang string, at array<int>, n array<int>")
    rows = rows.groupBy("_id", "lang").agg(F.max(F.struct("at", "n")).alias("v")).select("_id", "lang", "v.at", "v.n")
    with_arrow = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    try:
        frame = rows.toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", with_arrow)
    frame = frame.sort_values(["_id", "lang"])
    frame = frame.iloc[np.random.default_rng(3).permutation(len(frame))]
    return fit([(y, np.asarray(a, np.int64), np.asarray(c, float)) for y, a, c in zip(frame["lang"], frame["at"], frame["n"])])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``rejected`` for every row; only the text is looked at.

    Null texts and texts without a letter are ``und`` with score 0 and rejected; an empty table gives an empty result.
    """
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    rows = docs.select(*keep, docs[text_col].alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(batches):
            found = [shared.value.predict(t) for t in frame.pop("_text")]
            for i, name in enumerate(("lang_pred", "score", "rejected")):
                frame[name] = [f[i] for f in found]
            yield frame

    return rows.mapInPandas(run, schema)
